"""cairn - a Spark-native analytics engine for code and document intelligence."""

"""The canonical frames and how the given tables become them.

A few rows of every table are delivered twice, identical; ``distinct_rows`` keeps one. A file may also have rows of
earlier versions; ``current_files`` keeps the one with the largest ``indexed_at`` and adds the first-seen day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """One row for each key; twice-delivered rows are identical, so any of them will do."""
    return df.dropDuplicates([key])


def day_of(ms: F.Column | str) -> F.Column:
    """The UTC day (YYYY-MM-DD) of unix milliseconds."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def current_files(files: DataFrame) -> DataFrame:
    """file_id, path, lang, is_test of the current version, and first_day. A null file_id is no file."""
    newest = lambda c: F.max_by(F.col(c), F.struct("indexed_at", "path")).alias(c)
    return (
        files.where(F.col("file_id").isNotNull())
        .groupBy("file_id")
        .agg(newest("path"), newest("lang"), newest("is_test"), F.min("indexed_at").alias("first_ms"))
        .withColumn("first_day", day_of("first_ms"))
        .drop("first_ms")
    )

"""Version-control text as tables: diffs to changed line ranges, logs to churn per path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renamed(path: Column) -> Column:
    """The new side of ``a/{old => new}/b`` or ``old => new``."""
    inner = F.regexp_replace(path, r"\{[^{}]*? => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(inner, r"^.* => ", ""), r"//+", "/")


def hunks(diffs: DataFrame) -> DataFrame:
    """diff_id, path, start, count of the new side of each hunk, from (diff_id, text) in unified format."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    named = lines.withColumn("p", F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", "")))
    # the file of a hunk is the last header above it; a window runs inside one diff only
    named = named.withColumn("path", F.last("p", ignorenulls=True).over(Window.partitionBy("diff_id").orderBy("n")))
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    found = named.where(F.col("line").rlike(head))
    count = F.regexp_extract("line", head, 2)
    return found.select(
        "diff_id", "path", F.regexp_extract("line", head, 1).cast("int").alias("start"), F.when(count == "", 1).otherwise(F.expr("try_cast(" + "regexp_extract(line, '" + head.replace("\\", "\\\\") + "', 2) as int)")).alias("count")
    )


def churn(log_lines: DataFrame) -> DataFrame:
    """path, commits, added, deleted from the lines of a log with numbers per file (added TAB deleted TAB path).

    A dash stands for a binary file and counts as a commit only; a renamed file counts under its new path.
    """
    row = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    rows = log_lines.where(F.col("line").rlike(row)).select(
        renamed(F.regexp_extract("line", row, 3)).alias("path"),
        F.regexp_extract("line", row, 1).try_cast("bigint").alias("a"), F.regexp_extract("line", row, 2).try_cast("bigint").alias("d"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), zero("a").alias("added"), zero("d").alias("deleted"))


def touched_symbols(symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """symbol_id of the symbols that overlap a changed range (file_id, start, count); a pure deletion touches its place."""
    last = F.col("start") + F.greatest(F.col("count") - 1, F.lit(0))
    return symbols.join(changes, "file_id").where((F.col("start_line") <= last) & (F.col("end_line") >= F.col("start"))).select("symbol_id").distinct()

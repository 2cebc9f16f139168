"""Keeping index tables up to date from a stream of file changes.

Changes arrive as rows (path, event, content, ts); a batch keeps the last change of each path, leaves out those whose
content hash is already indexed, and rewrites the table as untouched rows plus new ones. Each batch writes a new
snapshot folder and then a small pointer file, so a lost batch leaves the last whole snapshot in force and is run again
from the stream's checkpoint (the batch id names the folder, so running it twice gives the same snapshot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, event string, content string, ts timestamp"
FILES = "path string, hash string, size long, changed_at timestamp"


class Snapshots:
    """A table as snapshot folders below a root, with a pointer to the one in force."""

    def __init__(self, spark: SparkSession, root: str, schema: str = FILES):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def current(self) -> DataFrame:
        pointer = self._pointer()
        if pointer is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{pointer}")

    def _pointer(self) -> str | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointers")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max(names) if names else None

    def publish(self, rows: DataFrame, batch_id: int) -> None:
        name = f"batch-{batch_id:012d}"
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointers/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()


def latest_changes(batch: DataFrame) -> DataFrame:
    """One row a path: its last event of the batch (ties go to a deletion, then to the larger content)."""
    order = Window.partitionBy("path").orderBy(F.desc("ts"), F.when(F.col("event") == "unlink", 0).otherwise(1), F.desc("content"))
    return batch.where("path is not null").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def apply_changes(files: DataFrame, batch: DataFrame) -> DataFrame:
    """The files table after a batch; unchanged content keeps its row as it was."""
    last = latest_changes(batch).select("path", "event", F.sha1("content").alias("hash"), F.length("content").cast("bigint").alias("size"), F.col("ts").alias("changed_at"))
    known = files.select("path", F.col("hash").alias("old"))
    fresh = last.where("event <> 'unlink' and hash is not null").join(known, "path", "left").where(~F.col("hash").eqNullSafe(F.col("old")))
    gone = last.where("event = 'unlink'").select("path")
    changed = fresh.select("path", "hash", "size", "changed_at")
    kept = files.join(gone.unionByName(changed.select("path")), "path", "left_anti")
    return kept.unionByName(changed)


def maintain(stream: DataFrame, snapshots: Snapshots, checkpoint: str) -> StreamingQuery:
    """Run the changes of a stream into the snapshots, batch after batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        snapshots.publish(apply_changes(snapshots.current(), batch), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(stream: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of changes per path in event time: what comes within the gap is one burst; works on streams and tables."""
    watched = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return watched.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))

"""Keeping a whole index up to date from a stream of file changes.

Each batch: the last change of every path; files whose content hash is indexed already are skipped; the others' rows give
way to those that ``extract`` finds in the new content; files that import a changed one or use a name it declares (or
declared) are resolved again, and only their index edges are made anew. All tables of a batch are one snapshot folder, and
a pointer to it is written last, so a batch that is lost leaves the snapshot before it in force and runs again.

``extract`` takes (file_id, path, content) and gives symbols, imports and occurrences with the columns of the tables, with
ids of their own. A new file's id is the 64-bit hash of its path; an older one keeps its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import resolution
from cairn.operators.lookups import resolution_pass, without_files
from cairn.streaming.changes import latest_changes

SCHEMAS = {
    "files": "file_id long, path string, hash string",
    "symbols": "symbol_id long, file_id long, name string, kind string, start_line int, start_col int, end_line int, end_col int, is_exported boolean",
    "imports": "import_id long, file_id long, specifier string, resolved_file_id long",
    "occurrences": "occ_id long, file_id long, name string, role string, start_line int, start_col int, resolved_symbol_id long, confidence double",
    "edges": "src_symbol_id long, dst_symbol_id long, kind string, confidence double, provenance string",
}
Extract = Callable[[DataFrame], dict[str, DataFrame]]


class Tables:
    """The tables of an index as attributes."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        for name, df in tables.items():
            setattr(self, name, df)

    def raw(self, name: str, *columns: str) -> DataFrame:
        return getattr(self, name).select(*columns)


def empty_index(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def local_names(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Open occurrences resolved to the exported symbol of their name: in their own file, else the only one anywhere."""
    here = symbols.groupBy(F.col("file_id").alias("hf"), F.col("name").alias("hn")).agg(F.min("symbol_id").alias("here"))
    all_ = symbols.where("is_exported").groupBy(F.col("name").alias("an")).agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("one")).where("n = 1")
    met = occurrences.join(here, (F.col("file_id") == F.col("hf")) & (F.col("name") == F.col("hn")), "left").join(all_, F.col("name") == F.col("an"), "left")
    found = F.coalesce("here", "one")
    sure = F.when(F.col("here").isNotNull(), 0.85).when(F.col("one").isNotNull(), 0.6)
    return met.select("occ_id", "file_id", "name", "role", "start_line", "start_col", found.alias("resolved_symbol_id"), sure.alias("confidence"))


def apply_batch(spark: SparkSession, tables: dict[str, DataFrame], batch: DataFrame, extract: Extract) -> dict[str, DataFrame]:
    """The tables after a batch of changes (path, event, content, ts)."""
    last = latest_changes(batch).select(F.col("path").alias("cpath"), "event", "content", F.sha1("content").alias("chash"))
    known = last.join(tables["files"], F.col("cpath") == F.col("path"), "left")
    gone = known.where("event = 'unlink' and file_id is not null").select("file_id")
    fresh = known.where((F.col("event") != "unlink") & F.col("chash").isNotNull() & ~F.col("chash").eqNullSafe(F.col("hash")))
    fresh = fresh.select(F.coalesce("file_id", F.xxhash64("cpath")).alias("file_id"), F.col("cpath").alias("path"), "content", F.col("chash").alias("hash"))
    changed = gone.unionByName(fresh.select("file_id")).distinct()
    before = Tables(spark, tables)
    lost_names = before.symbols.join(changed, "file_id", "left_semi").select("name")
    importers = before.imports.join(changed.withColumnRenamed("file_id", "resolved_file_id"), "resolved_file_id", "left_semi").select("file_id")

    kept = without_files(before, changed)
    made = extract(fresh.select("file_id", "path", "content"))
    made["files"] = fresh.select("file_id", "path", "hash")
    now = {name: kept[name].unionByName(made[name].select(*kept[name].columns)) if name in made else kept[name] for name in SCHEMAS}
    names = lost_names.unionByName(made["symbols"].select("name")).distinct()
    users = now["occurrences"].join(names, "name", "left_semi").select("file_id")
    scope = changed.unionByName(importers).unionByName(users).distinct()
    # occurrences of the scope are resolved again, the others stay as they are
    mine = now["occurrences"].join(scope, "file_id", "left_semi")
    rest = now["occurrences"].join(scope, "file_id", "left_anti")
    now["occurrences"] = rest.unionByName(local_names(mine, now["symbols"]))
    after = Tables(spark, now)
    now["edges"] = resolution_pass(after, scope, resolution.call_edges(after))
    return now


class IndexSnapshots:
    """All tables of an index as snapshot folders below a root, with a pointer to the one in force."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> dict[str, DataFrame]:
        where, fs = self._fs(f"{self.root}/pointers")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        if not names:
            return empty_index(self.spark)
        return {name: self.spark.read.schema(schema).parquet(f"{self.root}/{max(names)}/{name}") for name, schema in SCHEMAS.items()}

    def publish(self, tables: dict[str, DataFrame], batch_id: int) -> None:
        name = f"batch-{batch_id:012d}"
        for table, schema in SCHEMAS.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            tables[table].select(*columns).write.mode("overwrite").parquet(f"{self.root}/{name}/{table}")
        where, fs = self._fs(f"{self.root}/pointers/{name}")
        fs.create(where, True).close()


def maintain_index(stream: DataFrame, snapshots: IndexSnapshots, extract: Extract, checkpoint: str) -> StreamingQuery:
    """Run the changes of a stream into the index, batch after batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        snapshots.publish(apply_batch(snapshots.spark, snapshots.current(), batch, extract), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

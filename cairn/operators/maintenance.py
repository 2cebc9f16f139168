"""Index tables after single records are replaced: files with all that belongs to them, assets, vectors.

Tables are never changed in place: each function gives the rows that stay together with the new ones. Null ids stay out
of what is replaced; replacing by nothing is removing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.lookups import without_files
from cairn.operators.relational import Index


def replace_files(ix: Index, scope: DataFrame, fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables in which the files of ``scope`` (file_id) and all their rows give way to those of ``fresh``."""
    out = without_files(ix, scope)
    for name, rows in fresh.items():
        out[name] = out[name].unionByName(rows.select(*out[name].columns))
    return out


def replace_assets(assets: DataFrame, refs: DataFrame, scope: DataFrame, new_assets: DataFrame, new_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets and their references after those of ``scope`` (asset_id) are replaced."""
    gone = scope.select(F.col("asset_id").alias("gone_id")).where("gone_id is not null").distinct()
    keep = lambda df: df.join(gone, F.col("asset_id") == F.col("gone_id"), "left_anti")
    return keep(assets).unionByName(new_assets.select(*assets.columns)), keep(refs).unionByName(new_refs.select(*refs.columns))


def upsert_vectors(vectors: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """chunk_id, embedding, model, seq: the latest vector of each chunk; vectors of another model are dropped.

    seq counts writes; of equal ones the larger vector wins.
    """
    rows = vectors.unionByName(fresh.select(*vectors.columns)).where((F.col("model") == model) & F.col("chunk_id").isNotNull())
    last = Window.partitionBy("chunk_id").orderBy(F.desc("seq"), F.desc("embedding"))
    return rows.withColumn("at", F.row_number().over(last)).where("at = 1").drop("at")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_id, name, kind, change of two versions of the symbols (file_id, name, kind, signature) of the same files.

    change: added, removed, changed (another signature). Several symbols of a name and kind are compared as one, by the
    set of their signatures.
    """
    def folded(df: DataFrame, name: str) -> DataFrame:
        return df.where("file_id is not null and name is not null").groupBy("file_id", "name", F.coalesce("kind", F.lit("")).alias("kind")).agg(
            F.array_sort(F.collect_set(F.coalesce("signature", F.lit("")))).alias(name)
        )

    met = folded(old, "before").join(folded(new, "after"), ["file_id", "name", "kind"], "full")
    change = F.when(F.col("before").isNull(), F.lit("added")).when(F.col("after").isNull(), F.lit("removed")).when(F.col("before") != F.col("after"), F.lit("changed"))
    return met.select("file_id", "name", "kind", change.alias("change")).where("change is not null")


def broken_references(changes: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """occ_id, file_id, name: uses outside the file, by resolved id or, where unresolved, by name, of what was removed."""
    gone = changes.where("change = 'removed'").select(F.col("file_id").alias("home"), F.col("name").alias("gone_name"))
    ids = symbols.join(gone, (F.col("file_id") == F.col("home")) & (F.col("name") == F.col("gone_name"))).select(F.col("symbol_id").alias("gone_id"), "home")
    hard = occurrences.join(ids, (F.col("resolved_symbol_id") == F.col("gone_id")) & (F.col("file_id") != F.col("home")), "left_semi")
    # a name that some other file still declares isn't lost
    left = symbols.select("file_id", "name").distinct().join(gone, (F.col("file_id") == F.col("home")) & (F.col("name") == F.col("gone_name")), "left_anti").select(F.col("name").alias("still")).distinct()
    lost = gone.join(left, F.col("gone_name") == F.col("still"), "left_anti").groupBy("gone_name").agg(F.min("home").alias("home"))
    loose = occurrences.where("resolved_symbol_id is null").join(lost, (F.col("name") == F.col("gone_name")) & (F.col("file_id") != F.col("home")), "left_semi")
    return hard.select("occ_id", "file_id", "name").unionByName(loose.select("occ_id", "file_id", "name")).distinct()

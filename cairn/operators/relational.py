"""Counts, look-ups and joins over the canonical frames, each for all rows at once.

``Index`` gives the frames with twice-delivered rows once and files in their current version. Null keys never join;
empty frames give empty results.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.frames import current_files, distinct_rows, table
from cairn.functions.paths import parent_dir

CALLABLE = ["function", "method", "constructor", "macro", "class", "struct"]
TYPES = ["class", "interface", "struct", "trait", "enum", "type_alias", "impl"]
DEAD_KINDS = ["function", "method", "class", "struct", "interface", "trait", "enum"]


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)

    @cached_property
    def files(self) -> DataFrame:
        return current_files(self.raw("files", "file_id", "path", "lang", "indexed_at", "is_test"))

    @cached_property
    def symbols(self) -> DataFrame:
        return distinct_rows(self.raw("symbols"), "symbol_id")

    @cached_property
    def imports(self) -> DataFrame:
        return distinct_rows(self.raw("imports"), "import_id")

    @cached_property
    def occurrences(self) -> DataFrame:
        return distinct_rows(self.raw("occurrences"), "occ_id")

    @cached_property
    def edges(self) -> DataFrame:
        return upsert_edges(self.raw("edges"))

    @cached_property
    def assets(self) -> DataFrame:
        return distinct_rows(self.raw("assets"), "asset_id")

    @cached_property
    def asset_refs(self) -> DataFrame:
        return distinct_rows(self.raw("asset_refs"), "ref_id")

    def symbol_rows(self, *columns: str) -> DataFrame:
        files = self.files.select("file_id", "path", "lang", "is_test")
        return self.symbols.select("file_id", *columns).join(files, "file_id")


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, kind): the highest confidence, and the provenance that came with it (lsp over index)."""
    keys = ["src_symbol_id", "dst_symbol_id", "kind"]
    return edges.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.max_by("provenance", F.struct("confidence", "provenance")).alias("provenance")
    )


def counts_by_language(ix: Index) -> DataFrame:
    symbols = ix.symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return ix.files.join(symbols, "file_id", "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_symbols")
    )


def index_stats(ix: Index) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        for name, df in (("files", ix.files), ("symbols", ix.symbols), ("imports", ix.imports), ("occurrences", ix.occurrences), ("edges", ix.edges))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_stats(ix: Index) -> DataFrame:
    """Occurrences and resolved ones per language and role, and the part unresolved in percent."""
    rows = ix.occurrences.join(ix.files.select("file_id", "lang"), "file_id")
    return rows.groupBy("lang", "role").agg(
        F.count(F.lit(1)).alias("n"), F.count("resolved_symbol_id").alias("n_resolved"),
        F.round(100 * (1 - F.count("resolved_symbol_id") / F.count(F.lit(1))), 4).alias("pct_unresolved"),
    )


def name_occurrence_counts(ix: Index) -> DataFrame:
    return ix.occurrences.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolved_symbol_id").isNull()).alias("n_unresolved"))


def namespace_members(ix: Index) -> DataFrame:
    """The files that declare each namespace, sorted."""
    rows = ix.symbol_rows("kind", "qualified_name").where("kind = 'namespace'")
    return rows.groupBy("qualified_name").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def symbols_exact_name(ix: Index, limit: int = 10) -> DataFrame:
    """For every name the first rows in look-up order: exported first, then path, line and id."""
    order = Window.partitionBy("name").orderBy(F.desc("is_exported"), "path", "start_line", "symbol_id")
    rows = ix.symbol_rows("symbol_id", "name", "is_exported", "start_line")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("name", "place", "symbol_id", "path", "start_line")


def keyset_page(ix: Index, after: tuple[int, int] = (0, 0), size: int = 200, most: float = 0.6) -> DataFrame:
    """The next page of low-confidence call edges after a key, in key order."""
    low = ix.edges.where((F.col("kind") == "calls") & (F.col("provenance") == "index") & (F.col("confidence") <= most))
    key = F.struct("src_symbol_id", "dst_symbol_id")
    page = low.where(key > F.struct(F.lit(after[0]).cast("bigint"), F.lit(after[1]).cast("bigint")))
    return page.orderBy("src_symbol_id", "dst_symbol_id").limit(size).select("src_symbol_id", "dst_symbol_id", "confidence")


def dependencies(ix: Index) -> DataFrame:
    """Each import with its file and the file it leads to (null for outside packages)."""
    out = ix.files.select("file_id", F.col("path").alias("from_path"))
    to = ix.files.select(F.col("file_id").alias("to_id"), F.col("path").alias("to_path"))
    rows = ix.imports.select("import_id", "file_id", "specifier", "resolved_file_id").join(out, "file_id")
    return rows.join(to, F.col("resolved_file_id") == F.col("to_id"), "left").select("import_id", "from_path", "specifier", "to_path")


def import_pairs(ix: Index) -> DataFrame:
    """Distinct pairs of importing and imported file."""
    pairs = ix.imports.where("resolved_file_id is not null").select("file_id", "resolved_file_id").distinct()
    src = ix.files.select("file_id", F.col("path").alias("from_path"))
    dst = ix.files.select(F.col("file_id").alias("resolved_file_id"), F.col("path").alias("to_path"))
    return pairs.join(src, "file_id").join(dst, "resolved_file_id").select("file_id", "resolved_file_id", "from_path", "to_path")


def import_dir_weights(ix: Index) -> DataFrame:
    """How many file pairs lead from one folder to another."""
    pairs = import_pairs(ix).select(parent_dir(F.col("from_path")).alias("from_dir"), parent_dir(F.col("to_path")).alias("to_dir"))
    return pairs.where("from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count(F.lit(1)).alias("weight"))


def dead_candidates(ix: Index) -> DataFrame:
    """Symbols that nothing refers to: no resolved occurrence, no edge into them, no callable around them."""
    rows = ix.symbol_rows("symbol_id", "name", "kind", "parent_symbol_id", "is_exported", "start_line").where(F.col("kind").isin(DEAD_KINDS))
    used = ix.raw("occurrences", "resolved_symbol_id").where("resolved_symbol_id is not null").select(F.col("resolved_symbol_id").alias("used")).distinct()
    called = ix.raw("edges", "dst_symbol_id").where("dst_symbol_id is not null").select(F.col("dst_symbol_id").alias("called")).distinct()
    around = ix.symbols.where(F.col("kind").isin("function", "method", "constructor")).select(F.col("symbol_id").alias("around"))
    return (
        rows.join(used, F.col("symbol_id") == F.col("used"), "left_anti")
        .join(called, F.col("symbol_id") == F.col("called"), "left_anti")
        .join(around, F.col("parent_symbol_id") == F.col("around"), "left_anti")
        .select("symbol_id", "name", "kind", "path", "lang", "is_test", "is_exported", "start_line")
    )


def internal_only_exports(ix: Index) -> DataFrame:
    """Exported symbols that are used, but only inside their own file."""
    sym = ix.symbols.where("is_exported").select("symbol_id", "name", "kind", F.col("file_id").alias("home"))
    uses = ix.raw("occurrences", "resolved_symbol_id", "file_id").where("resolved_symbol_id is not null")
    uses = uses.select(F.col("resolved_symbol_id").alias("sid"), F.col("file_id").alias("user")).distinct()
    src = ix.symbols.select(F.col("symbol_id").alias("src"), F.col("file_id").alias("user"))
    edges = ix.raw("edges", "src_symbol_id", "dst_symbol_id").distinct().join(src, F.col("src_symbol_id") == F.col("src"))
    both = uses.unionByName(edges.select(F.col("dst_symbol_id").alias("sid"), "user")).distinct()
    seen = sym.join(both, F.col("symbol_id") == F.col("sid"))
    flags = seen.groupBy("symbol_id").agg(F.max((F.col("user") != F.col("home")).cast("int")).alias("outside"))
    return sym.join(flags.where("outside = 0"), "symbol_id").select("symbol_id", "name", "kind", F.col("home").alias("file_id"))


def find_references(ix: Index) -> DataFrame:
    """Per symbol: occurrences resolved to it, and unresolved ones of its name in other files (two equi-joins)."""
    occ = ix.occurrences.select("occ_id", "file_id", "name", "resolved_symbol_id")
    hard = occ.where("resolved_symbol_id is not null").groupBy(F.col("resolved_symbol_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n_resolved"))
    loose = occ.where("resolved_symbol_id is null").groupBy("name").agg(F.count(F.lit(1)).alias("n_name"))
    own = occ.where("resolved_symbol_id is null").groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n_own"))
    rows = ix.symbols.select("symbol_id", "file_id", "name").join(hard, "symbol_id", "left").join(loose, "name", "left").join(own, ["file_id", "name"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("symbol_id", zero("n_resolved").alias("n_resolved"), (zero("n_name") - zero("n_own")).alias("n_possible"))


def file_line_counts(ix: Index) -> DataFrame:
    return ix.symbols.groupBy("file_id").agg(F.max("end_line").alias("n_lines"))


BLOCK_LINES = 50


def enclosing_symbols(ix: Index, where: str = "role = 'call' and resolved_symbol_id is not null") -> DataFrame:
    """occ_id, resolved_symbol_id, confidence, enclosing_symbol_id: the innermost symbol around each occurrence.

    Innermost is the one that begins last; then the one that ends first, then the lower id. Both sides meet by file and
    block of lines, so an occurrence meets the symbols near it, not all of a large file.
    """
    block = lambda line: F.floor(F.col(line) / BLOCK_LINES)
    occ = ix.occurrences.where(where).select("occ_id", "file_id", block("start_line").alias("block"), F.struct("start_line", "start_col").alias("at"), "resolved_symbol_id", "confidence")
    sym = ix.symbols.where("end_line >= start_line").select(
        "file_id", "symbol_id", F.struct("start_line", "start_col").alias("s"), F.struct("end_line", "end_col").alias("e"), F.explode(F.sequence(block("start_line"), block("end_line"))).alias("block")
    )
    inside = occ.join(sym, ["file_id", "block"]).where("at >= s and at <= e")
    rank = F.struct(F.col("s.start_line"), F.col("s.start_col"), -F.col("e.end_line"), -F.col("e.end_col"), -F.col("symbol_id"))
    return inside.groupBy("occ_id", "resolved_symbol_id", "confidence").agg(F.max_by("symbol_id", rank).alias("enclosing_symbol_id"))


def hash_skip(ix: Index) -> DataFrame:
    """Files to read again: the content's sha1 differs from the indexed hash, or that is null."""
    files = ix.raw("files", "file_id", "path", "hash", "indexed_at").where("file_id is not null")
    cur = files.groupBy("file_id").agg(F.max_by(F.struct("path", "hash"), "indexed_at").alias("f")).select("file_id", "f.path", "f.hash")
    now = ix.raw("sources", "path", "content").where("content is not null").select("path", F.sha1("content").alias("now")).distinct()
    return cur.join(now, "path").where(~F.col("hash").eqNullSafe(F.col("now"))).select("file_id", "path")


def vector_reuse(ix: Index) -> DataFrame:
    """Chunks whose vector another chunk already has: the lowest id with the same vector is reused."""
    rows = ix.raw("chunk_vectors").where("embedding is not null").groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
    first = rows.groupBy("embedding").agg(F.min("chunk_id").alias("reused_chunk_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(first, "embedding").where("chunk_id <> reused_chunk_id").select("chunk_id", "reused_chunk_id")


def asset_stats(ix: Index) -> DataFrame:
    return ix.assets.groupBy("engine", "kind").agg(F.count(F.lit(1)).alias("n"))


def guid_references(ix: Index) -> DataFrame:
    """References by guid with the asset that declares the guid (lowest path if several do)."""
    refs = ix.asset_refs.where("target is not null")
    paths = ix.assets.select("asset_id", "path")
    owners = refs.where("target_kind = 'guid_of'").join(paths, "asset_id").groupBy("target").agg(F.min(F.regexp_replace("path", r"\.meta$", "")).alias("owner_path"))
    users = refs.where("target_kind in ('script', 'prefab', 'asset') and not startswith(target, 'res://')").join(paths, "asset_id")
    return users.join(owners, "target", "left").select("ref_id", "target", F.col("path").alias("user_path"), "owner_path")


def debounced_batches(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of changes per source of events: a batch ends when nothing came for the gap."""
    rows = events.where("ts is not null").withColumn("t", F.col("ts").cast("timestamp"))
    batches = rows.groupBy("user_id", F.session_window("t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_types"), F.max("t").alias("last"))
    return batches.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n_events", "n_types")

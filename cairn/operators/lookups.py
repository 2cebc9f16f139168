"""Look-ups of the index answered for every key at once: references, neighbours, places, call sites, maintenance.

Null keys and references meet nothing; twice-delivered rows count once; an empty table gives an empty result. Limits
(``k``) are those of the look-ups themselves: the best k rows of each key, in a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import changed_files
from cairn.operators.relational import Index, upsert_edges

REACHED_BY = ["calls", "extends", "implements", "overrides"]


def top(rows: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows before the shuffle, so a hot key sends k rows a task."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def reference_rows(ix: Index, k: int = 50) -> DataFrame:
    """Per symbol its first k references: resolved ones, then unresolved ones of its name, each by path and line.

    Unresolved occurrences are ranked once a name, not once a symbol, so a name with many symbols isn't multiplied.
    """
    paths = ix.files.select(F.col("file_id").alias("fid"), "path")
    occ = ix.occurrences.select("occ_id", "file_id", "name", "start_line", "resolved_symbol_id").join(paths, F.col("file_id") == F.col("fid"))
    place = ["path", "start_line", "occ_id"]
    hard = top(occ.where("resolved_symbol_id is not null"), ["resolved_symbol_id"], place, k).select(F.col("resolved_symbol_id").alias("symbol_id"), *place)
    loose = top(occ.where("resolved_symbol_id is null and name is not null"), ["name"], place, k).select("name", *place)
    named = ix.symbols.select("symbol_id", "name").join(loose, "name").select("symbol_id", *place)
    both = hard.withColumn("is_resolved", F.lit(True)).unionByName(named.withColumn("is_resolved", F.lit(False)))
    known = ix.symbols.select("symbol_id")
    return top(both.join(known, "symbol_id", "left_semi"), ["symbol_id"], [F.desc("is_resolved"), *place], k).select("symbol_id", "rank", "occ_id", "path", "start_line", "is_resolved")


def neighbours(ix: Index, k: int = 25) -> DataFrame:
    """symbol_id, direction, rank, kind, other_id: the first k neighbours of every symbol each way, surest first, then by name."""
    names = ix.symbols.select(F.col("symbol_id").alias("other_id"), "name")
    edges = ix.edges.where(F.col("kind").isin(REACHED_BY))
    out = edges.select(F.col("src_symbol_id").alias("symbol_id"), F.lit("out").alias("direction"), F.col("dst_symbol_id").alias("other_id"), "kind", "confidence")
    into = edges.select(F.col("dst_symbol_id").alias("symbol_id"), F.lit("in").alias("direction"), F.col("src_symbol_id").alias("other_id"), "kind", "confidence")
    rows = out.unionByName(into).where("symbol_id is not null").join(names, "other_id")
    order = [F.desc_nulls_last("confidence"), "name", "other_id", "kind"]
    return top(rows, ["symbol_id", "direction"], order, k).select("symbol_id", "direction", "rank", "kind", "other_id")


def occurrence_at(ix: Index) -> DataFrame:
    """symbol_id, occ_id: the occurrence at each symbol's first line and column, else the nearest one on that line."""
    at = ix.symbols.select("symbol_id", "file_id", "start_line", F.col("start_col").alias("col"))
    occ = ix.occurrences.select("occ_id", "file_id", "start_line", "start_col", "end_line", "end_col")
    met = at.join(occ, ["file_id", "start_line"])
    spans = (F.col("start_col") <= F.col("col")) & ((F.col("end_line") > F.col("start_line")) | (F.col("end_col") > F.col("col")))
    far = F.struct((~F.coalesce(spans, F.lit(False))).alias("off"), F.abs(F.col("start_col") - F.col("col")).alias("d"), "start_col", "occ_id")
    return met.groupBy("symbol_id").agg(F.min_by("occ_id", far).alias("occ_id"))


def call_sites(ix: Index) -> DataFrame:
    """src_symbol_id, dst_symbol_id, n_sites, first_line of every call edge: the calls inside the source's lines that resolve to the target."""
    edges = ix.edges.where("kind = 'calls'").select("src_symbol_id", "dst_symbol_id")
    span = ix.symbols.select(F.col("symbol_id").alias("src_symbol_id"), "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    # only lines on which a file calls the target: a generated file's calls are counted by line first
    calls = ix.occurrences.where("role = 'call' and resolved_symbol_id is not null").groupBy("file_id", F.col("resolved_symbol_id").alias("dst_symbol_id"), "start_line").agg(F.count(F.lit(1)).alias("n"))
    met = edges.join(span, "src_symbol_id").join(calls, ["file_id", "dst_symbol_id"]).where("start_line between a and z")
    return met.groupBy("src_symbol_id", "dst_symbol_id").agg(F.sum("n").alias("n_sites"), F.min("start_line").alias("first_line"))


def batch_symbols(ix: Index, ids: DataFrame) -> DataFrame:
    """place, symbol_id, found, name, kind for a list of ids (place, symbol_id), in its order."""
    rows = ix.symbols.select(F.col("symbol_id").alias("sid"), "name", "kind")
    return ids.join(rows, F.col("symbol_id") == F.col("sid"), "left").select("place", "symbol_id", F.col("sid").isNotNull().alias("found"), "name", "kind")


def removal_status(ix: Index) -> DataFrame:
    """Per table: dropped records that are still gone and those that came back."""
    gone = ix.raw("removals", "rec_table", "rec_id").where("rec_id is not null").distinct()
    there = ix.files.select(F.lit("files").alias("t"), F.col("file_id").alias("id")).unionByName(ix.symbols.select(F.lit("symbols").alias("t"), F.col("symbol_id").alias("id")))
    met = gone.join(there, (F.col("rec_table") == F.col("t")) & (F.col("rec_id") == F.col("id")), "left")
    return met.groupBy("rec_table").agg(F.count_if(F.col("id").isNull()).alias("n_gone"), F.count("id").alias("n_back"))


def without_files(ix: Index, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after files are removed (file_id): their child rows go, and edges at either end of their symbols."""
    gone = gone.select(F.col("file_id").alias("gone_file")).where("gone_file is not null").distinct()
    keep = lambda df, key: df.join(gone, F.col(key) == F.col("gone_file"), "left_anti")
    lost = ix.symbols.join(gone, F.col("file_id") == F.col("gone_file"), "left_semi").select(F.col("symbol_id").alias("lost_id"))
    edges = ix.edges
    for end in ("src_symbol_id", "dst_symbol_id"):
        edges = edges.join(lost, F.col(end) == F.col("lost_id"), "left_anti")
    # references into what is gone become open again
    occ = keep(ix.occurrences, "file_id").join(lost, F.col("resolved_symbol_id") == F.col("lost_id"), "left")
    open_ = lambda c: F.when(F.col("lost_id").isNull(), F.col(c)).alias(c)
    occ = occ.select(*[open_(c) if c in ("resolved_symbol_id", "confidence") else F.col(c) for c in ix.occurrences.columns])
    imports = keep(ix.imports, "file_id").join(gone, F.col("resolved_file_id") == F.col("gone_file"), "left")
    imports = imports.select(*[F.when(F.col("gone_file").isNull(), F.col(c)).alias(c) if c == "resolved_file_id" else F.col(c) for c in ix.imports.columns])
    return {"files": keep(ix.files, "file_id"), "symbols": keep(ix.symbols, "file_id"), "imports": imports, "occurrences": occ, "edges": edges}


def removal_cascade(ix: Index) -> DataFrame:
    """Rows and resolved references of each table after the changed files are removed."""
    left = without_files(ix, changed_files(ix))
    marks = {"imports": "resolved_file_id", "occurrences": "resolved_symbol_id"}
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(marks[name]) if name in marks else F.lit(None).cast("bigint")).alias("n_resolved"))
        part = part.select(F.lit(name).alias("table_name"), "n_rows", "n_resolved")
        out = part if out is None else out.unionByName(part)
    return out


def resolution_pass(ix: Index, scope: DataFrame, fresh: DataFrame) -> DataFrame:
    """The edges after the files in ``scope`` (file_id) are resolved again: index edges from them give way to ``fresh``."""
    own = ix.symbols.join(scope.select("file_id").distinct(), "file_id", "left_semi").select(F.col("symbol_id").alias("own"))
    stale = ix.edges.where("provenance = 'index'").join(own, F.col("src_symbol_id") == F.col("own"), "left_anti")
    new = fresh.join(own, F.col("src_symbol_id") == F.col("own"), "left_semi")
    kept = ix.edges.where("provenance <> 'index' or provenance is null")
    return upsert_edges(kept.unionByName(stale).unionByName(new.select(*ix.edges.columns)))


def name_positions(ix: Index, within: int = 5) -> DataFrame:
    """symbol_id, line: the first of a symbol's leading lines that holds its name as a word; null if none does."""
    texts = ix.raw("sources", "path", "content").where("content is not null").dropDuplicates(["path"])
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n").alias("lines")
    texts = ix.files.select("file_id", "path").join(texts, "path").select("file_id", lines)
    sym = ix.symbols.where("name rlike '^[A-Za-z_]\\\\w*$' and start_line > 0").select("symbol_id", "file_id", "name", "start_line")
    head = sym.join(texts, "file_id").select("symbol_id", "name", "start_line", F.slice("lines", F.col("start_line"), F.lit(within)).alias("head"))
    at = F.array_min(F.filter(F.transform("head", lambda x, i: F.when(F.array_contains(F.split(x, r"[^A-Za-z0-9_]+"), F.col("name")), i)), lambda i: i.isNotNull()))
    return head.select("symbol_id", (F.col("start_line") + at).alias("line"))


def hierarchy_levels(ix: Index, seeds: DataFrame, kinds: list[str], depth: int, k: int) -> DataFrame:
    """root_id, depth, parent_id, symbol_id: callers (or subtypes) of each seed, level by level.

    Each node shows its first k neighbours (surest, then by name and id), and each symbol comes once below a root: at its
    first level, under the lowest parent of that level.
    """
    names = ix.symbols.select(F.col("symbol_id").alias("to"), "name")
    edges = ix.edges.where(F.col("kind").isin(kinds)).groupBy(F.col("dst_symbol_id").alias("at"), F.col("src_symbol_id").alias("to")).agg(F.max("confidence").alias("c"))
    shown = top(edges.where("at is not null").join(names, "to"), ["at"], [F.desc_nulls_last("c"), "name", "to"], k).select("at", "to")
    level = seeds.select(F.col("symbol_id").alias("root_id"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent_id"), "symbol_id").distinct()
    seen = level
    for d in range(1, depth + 1):
        step = level.select("root_id", F.col("symbol_id").alias("at")).join(shown, "at").groupBy("root_id", F.col("to").alias("symbol_id")).agg(F.min("at").alias("parent_id"))
        level = step.join(seen.select("root_id", "symbol_id"), ["root_id", "symbol_id"], "left_anti").select("root_id", F.lit(d).alias("depth"), "parent_id", "symbol_id")
        seen = seen.unionByName(level)
    return seen.where("depth > 0")

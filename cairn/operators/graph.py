"""Walks over the symbol and import graphs, level by level.

A level is one join of the last level's nodes with the edges; what was reached before is taken out by an anti-join, and
each level is written to the shared folder, so plans don't grow and lost executors cost one level. No caps on fan-in or
on visited nodes: a walk ends at its depth or when nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cairn.operators.relational import Index
from cairn.session import Scratch

CALL_KINDS = ["calls", "extends", "implements", "overrides"]


def walk(edges: DataFrame, seeds: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """node, depth, via from edges (at, to, weight) and seeds (node): the fewest steps to every node in reach.

    via is the node a step before: of several the one over the heaviest edge, then the lowest.
    """
    level = scratch.save(seeds.select("node").where("node is not null").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("via")), "level")
    edges = scratch.save(edges.where("at is not null and to is not null and at <> to"), "edges")
    reached = level
    for d in range(1, depth + 1):
        seen = Observation()
        step = (
            edges.join(level.select("node"), F.col("at") == F.col("node"))
            .groupBy("to")
            .agg(F.max(F.struct(F.col("weight"), (-F.col("at")).alias("neg"))).alias("best"))
            .join(reached.select("node"), F.col("to") == F.col("node"), "left_anti")
            .select(F.col("to").alias("node"), F.lit(d).alias("depth"), (-F.col("best.neg")).alias("via"))
        )
        level = scratch.save(step.observe(seen, F.count(F.lit(1)).alias("n")), "level")
        if not seen.get["n"]:
            break
        reached = reached.unionByName(level)
    return reached


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """source_id, target_id, steps, path (ids with ``>`` between) of the pairs (source_id, target_id) that a path joins.

    edges: at, to, weight. Each source is walked level by level, a node is kept at its first level only, and comes from the
    node a step before over the heaviest edge, then from the lowest. Then the paths are read backwards, a step of all at once.
    """
    pairs = pairs.select("source_id", "target_id").where("source_id is not null and target_id is not null").distinct()
    edges = scratch.save(edges.where("at is not null and to is not null and at <> to"), "edges")
    level = pairs.select("source_id", F.col("source_id").alias("node"), F.lit(None).cast("bigint").alias("via"), F.lit(0).alias("steps")).distinct()
    levels = [scratch.save(level, "level")]
    for d in range(1, depth + 1):
        seen = Observation()
        step = levels[-1].select("source_id", F.col("node").alias("at")).join(edges, "at").groupBy("source_id", F.col("to").alias("node")).agg(F.max(F.struct("weight", (-F.col("at")).alias("neg"))).alias("best"))
        step = step.join(scratch.together(levels).select("source_id", "node"), ["source_id", "node"], "left_anti")
        step = step.select("source_id", "node", (-F.col("best.neg")).alias("via"), F.lit(d).alias("steps"))
        levels.append(scratch.save(step.observe(seen, F.count(F.lit(1)).alias("n")), "level"))
        if not seen.get["n"]:
            break
    reached = scratch.together(levels)
    found = pairs.join(reached, (pairs["source_id"] == reached["source_id"]) & (F.col("target_id") == F.col("node"))).select(pairs["source_id"], "target_id", "steps", "via", F.col("target_id").cast("string").alias("path"))
    back = reached.select(F.col("source_id").alias("bs"), F.col("node").alias("bn"), F.col("via").alias("bv"))
    for _ in range(len(levels) - 1):
        open_ = found.join(back, (F.col("source_id") == F.col("bs")) & (F.col("via") == F.col("bn")), "left")
        found = open_.select("source_id", "target_id", "steps", F.col("bv").alias("via"), F.when(F.col("via").isNull(), F.col("path")).otherwise(F.concat(F.col("via").cast("string"), F.lit(">"), "path")).alias("path"))
    return found.select("source_id", "target_id", "steps", "path")


def changed_files(ix: Index) -> DataFrame:
    """Files that were indexed more than once with different times: the ones that changed."""
    rows = ix.raw("files", "file_id", "indexed_at").where("file_id is not null")
    return rows.groupBy("file_id").agg(F.countDistinct("indexed_at").alias("n")).where("n > 1").select("file_id")


def impact(ix: Index, least: float = 0.5, depth: int = 6) -> DataFrame:
    """symbol_id, depth, via: everything that reaches a symbol of a changed file against the edges' direction."""
    edges = ix.edges.where(F.col("kind").isin(CALL_KINDS) & (F.col("confidence") >= least))
    edges = edges.groupBy(F.col("dst_symbol_id").alias("at"), F.col("src_symbol_id").alias("to")).agg(F.max("confidence").alias("weight"))
    seeds = ix.symbols.join(changed_files(ix), "file_id").select(F.col("symbol_id").alias("node"))
    return walk(edges, seeds, depth, Scratch(ix.spark, "impact")).withColumnRenamed("node", "symbol_id")


def import_reach(ix: Index, depth: int = 4) -> DataFrame:
    """file_id, depth: files that import a changed file, directly or over others."""
    edges = ix.imports.select(F.col("resolved_file_id").alias("at"), F.col("file_id").alias("to")).distinct().withColumn("weight", F.lit(1.0))
    seeds = changed_files(ix).select(F.col("file_id").alias("node"))
    return walk(edges, seeds, depth, Scratch(ix.spark, "reach")).select(F.col("node").alias("file_id"), "depth")


def impact_files(ix: Index) -> DataFrame:
    """file_id, path, is_test, depth, layer of each file touched by the changes; a call path beats an import path."""
    calls = impact(ix).where("depth > 0").join(ix.symbols.select("symbol_id", "file_id"), "symbol_id").groupBy("file_id").agg(F.min("depth").alias("call_depth"))
    reach = import_reach(ix).where("depth > 0").withColumnRenamed("depth", "import_depth")
    both = calls.join(reach, "file_id", "full").join(changed_files(ix), "file_id", "left_anti")
    return both.join(ix.files.select("file_id", "path", "is_test"), "file_id").select(
        "file_id", "path", "is_test", F.coalesce("call_depth", "import_depth").alias("depth"), F.when(F.col("call_depth").isNotNull(), F.lit("calls")).otherwise(F.lit("imports")).alias("layer")
    )


def tests_for_changes(ix: Index) -> DataFrame:
    return impact_files(ix).where("is_test").select("file_id", "path", "depth", "layer")


def call_depths(ix: Index, depth: int = 6) -> DataFrame:
    """symbol_id, depth, via: the fewest calls from any symbol of a test file to each symbol."""
    edges = ix.edges.where("kind = 'calls'").select(F.col("src_symbol_id").alias("at"), F.col("dst_symbol_id").alias("to"), F.col("confidence").alias("weight"))
    seeds = ix.symbol_rows("symbol_id").where("is_test").select(F.col("symbol_id").alias("node"))
    return walk(edges, seeds, depth, Scratch(ix.spark, "calls")).withColumnRenamed("node", "symbol_id")


def affected_files(ix: Index) -> DataFrame:
    """Files to resolve again after the changes: the changed ones, their importers, and those that use a name they declare."""
    changed = changed_files(ix)
    importers = ix.imports.join(changed.withColumnRenamed("file_id", "resolved_file_id"), "resolved_file_id").select("file_id")
    names = ix.symbols.join(changed, "file_id").select("name").distinct()
    users = ix.raw("occurrences", "file_id", "name").join(names, "name", "left_semi").select("file_id")
    return changed.unionByName(importers).unionByName(users).distinct()


def degrees(ix: Index) -> DataFrame:
    """Fan-in and fan-out of every symbol with an edge, by kind."""
    ins = ix.edges.groupBy(F.col("dst_symbol_id").alias("symbol_id"), "kind").agg(F.count(F.lit(1)).alias("n_in"))
    outs = ix.edges.groupBy(F.col("src_symbol_id").alias("symbol_id"), "kind").agg(F.count(F.lit(1)).alias("n_out"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ins.join(outs, ["symbol_id", "kind"], "full").select("symbol_id", "kind", zero("n_in").alias("n_in"), zero("n_out").alias("n_out"))

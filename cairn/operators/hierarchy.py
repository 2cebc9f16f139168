"""Parent-child links to full hierarchies, by tree contraction.

Each round first *rakes* (takes away all leaves) and then *compresses* (takes out of every chain of only children a set
of nodes no two of which touch, and links the child of each to its parent). Depth therefore costs a logarithmic number of
rounds, however long a chain is. A circle can't be raked; compression shrinks it to one node that is its own parent, and
reading the records backwards, from a child to the node that was compressed above it, gives all members of the circle.

A second contraction goes over what is on no circle. It carries the piece of path from the parent (exclusive) to the node
(inclusive) and adds up the sizes of what was raked; read backwards, its records give every node its root, depth, path and
number of descendants. So no row ever holds more than one path, and circles of any size are rows, never arrays.

Parents with more than 1/200 of all children (there can be at most 200) are salted wherever rows meet their parent.

Defined results: a null id is no node; repeated rows of an id count once (the smallest parent and name win); a null
parent or one without a row makes a root; a null name is an empty path piece. Nodes of a circle have status ``cycle``,
no root, depth, path or number of descendants; nodes hanging below a circle have status ``below_cycle``, no root or
depth, and a path that starts below the circle. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairn.session import Scratch

STAYS, COMPRESSED, RAKED = 0, 1, 2
HOT_SHARE, SALTS = 200, 16


def _linked() -> Column:
    return F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))


@dataclass
class Contraction:
    """The nodes, what is left of them (roots and nodes that are their own parent) and the rounds' tables, in order."""

    nodes: DataFrame
    hot: DataFrame
    survivors: DataFrame
    records: list[DataFrame] = field(default_factory=list)
    scratch: Scratch | None = None


def _meet_parents(rows: DataFrame, above: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """rows joined to ``above`` (one row for each ``aid``) by their parent; the children of hot parents are spread."""
    flagged = rows.join(F.broadcast(hot), F.col("parent") == F.col("hot_id"), "left")
    salt = F.when(F.col("hot_id").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    rows = flagged.withColumn("salt", salt).drop("hot_id")
    every = F.when(F.col("hot_id").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    above = above.join(F.broadcast(hot), F.col("aid") == F.col("hot_id"), "left").withColumn("asalt", F.explode(every)).drop("hot_id")
    return rows.join(above, (F.col("parent") == F.col("aid")) & (F.col("salt") == F.col("asalt")), how).drop("salt", "asalt")


def _nodes(df: DataFrame, id_col: str, parent_col: str, name_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """id, parent (null if it has no row), name; and the parents with more than 1/200 of all children."""
    seen = Observation()
    rows = (
        df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(name_col).alias("name"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("parent").alias("parent"), F.coalesce(F.min("name"), F.lit("")).alias("name"))
    )
    rows = scratch.save(rows.observe(seen, F.count("parent").alias("children")), "rows")
    bound = max(1, seen.get["children"] or 0) / HOT_SHARE
    hot = rows.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    hot = scratch.save(hot.where(F.col("n") > F.lit(bound) + SALTS).select(F.col("parent").alias("hot_id")), "hot")
    # rows without a parent stay out of the join, else they would all meet in one task
    linked = _meet_parents(rows.where("parent is not null"), rows.select(F.col("id").alias("aid")), hot, "left")
    nodes = rows.where("parent is null").unionByName(linked.select("id", F.col("aid").alias("parent"), "name"))
    return scratch.save(nodes, "nodes"), hot


def _rounds(nodes: DataFrame, scratch: Scratch, full: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Survivors and one written table a round: rows that stay (with their new parent), were compressed or were raked.

    nodes: id, parent; if ``full`` also seg (piece of path), w (own size so far), extra (size of what was compressed
    between it and its parent) and under (what a root hangs below). Records of compressed rows name their child and what
    lay between the two then.
    """
    carried = ["seg", "w", "extra", "under"] if full else []

    def write(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        saved = scratch.save(rows.observe(seen, F.count_if(_linked() & (F.col("out") == STAYS)).alias("left")), "round")
        return saved, seen.get["left"]

    nobody = F.lit(None).cast("bigint")
    table, left = write(nodes.select("id", "parent", nobody.alias("child"), *carried, F.lit(STAYS).alias("out")))
    records: list[DataFrame] = []
    turn = 0
    while left:
        turn += 1
        active = table.where(F.col("out") == STAYS).select("id", "parent", *carried)
        kids = active.where(_linked()).groupBy(F.col("parent").alias("pid")).agg(F.lit(True).alias("has_child"))
        marked = active.join(kids, F.col("id") == F.col("pid"), "left").select("id", "parent", *carried, (_linked() & F.col("has_child").isNull()).alias("leaf"))
        # what each parent has: children that stay, and the size of those that are raked
        sums = [F.sum(F.when(F.col("leaf"), F.col("w") + F.col("extra"))).alias("gain")] if full else []
        have = marked.where(_linked()).groupBy(F.col("parent").alias("vid")).agg(
            F.count_if(~F.col("leaf")).alias("n"), F.max(F.when(~F.col("leaf"), F.col("id"))).alias("only"), *sums
        )
        rest = marked.where(~F.col("leaf")).drop("leaf").join(have, F.col("id") == F.col("vid"), "left")
        if full:
            rest = rest.withColumn("w", F.col("w") + F.coalesce("gain", F.lit(0)))
        # compress: the parent of an only child goes if its hash is above those of its own parent and child
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
        gone = F.coalesce(_linked() & (F.col("n") == 1) & (rank("id") > rank("parent")) & (rank("id") > rank("only")), F.lit(False))
        above = rest.where(gone).select(F.col("only").alias("at"), *[F.col(c).alias(f"x_{c}") for c in ("id", "parent", *carried)])
        stay = rest.where(~gone).join(above, F.col("id") == F.col("at"), "left")
        met = F.col("x_id").isNotNull()
        own = [F.col("id"), F.coalesce("x_parent", "parent").alias("parent"), nobody.alias("child")]
        record = [F.col("x_id").alias("id"), F.col("x_parent").alias("parent"), F.col("id").alias("child")]
        if full:
            between = F.coalesce(F.col("x_w") + F.col("x_extra"), F.lit(0))
            own += [F.when(met, F.concat("x_seg", "seg")).otherwise(F.col("seg")).alias("seg"), "w", (F.col("extra") + between).alias("extra"), "under"]
            record += [F.col("x_seg").alias("seg"), F.col("x_w").alias("w"), "extra", F.col("x_under").alias("under")]
        both = F.array(F.struct(*own, F.lit(STAYS).alias("out")), F.when(met, F.struct(*record, F.lit(COMPRESSED).alias("out"))))
        kept = stay.select(F.explode(F.filter(both, lambda r: r.isNotNull())).alias("r")).select("r.*")
        raked = marked.where("leaf").select("id", "parent", nobody.alias("child"), *carried, F.lit(RAKED).alias("out"))
        table, left = write(kept.unionByName(raked))
        records.append(table)
    return table.where(F.col("out") == STAYS), records


def contract(df: DataFrame, id_col: str, parent_col: str, name_col: str) -> Contraction:
    scratch = Scratch(df.sparkSession, "hierarchy")
    nodes, hot = _nodes(df, id_col, parent_col, name_col, scratch)
    survivors, records = _rounds(nodes.select("id", "parent"), scratch, full=False)
    return Contraction(nodes, hot, survivors, records, scratch)


def cycle_members(done: Contraction) -> DataFrame:
    """id, cycle_id: the nodes that are their own ancestors; cycle_id is the smallest id of the circle."""
    seen = Observation()
    cores = done.survivors.where(F.col("parent") == F.col("id")).select("id", F.col("id").alias("core"))
    known = [done.scratch.save(cores.observe(seen, F.count(F.lit(1)).alias("n")), "circle")]
    for table in reversed(done.records) if seen.get["n"] else ():
        below = done.scratch.together(known).select(F.col("id").alias("cid"), "core")
        # what was compressed above a member of a circle is one, too
        found = table.where(F.col("out") == COMPRESSED).select("id", "child").join(below, F.col("child") == F.col("cid"))
        known.append(done.scratch.save(found.select("id", "core"), "circle"))
    members = done.scratch.together(known)
    least = members.groupBy(F.col("core").alias("c")).agg(F.min("id").alias("cycle_id"))
    return members.join(least, F.col("core") == F.col("c")).select("id", "cycle_id")


def expand(done: Contraction) -> DataFrame:
    """id, status, root_id, depth, path_ids, path_names, cycle_id, n_descendants of every node."""
    scratch, hot = done.scratch, done.hot
    circles = scratch.save(cycle_members(done), "circles")
    apart = done.nodes.join(circles.select(F.col("id").alias("cid")), F.col("id") == F.col("cid"), "left_anti")
    # nodes right below a circle become tops that remember it
    over = circles.select(F.col("id").alias("aid"), F.col("cycle_id").alias("under"))
    linked = _meet_parents(apart.where("parent is not null"), over, hot, "left")
    seg = F.array(F.struct("id", "name")).alias("seg")
    forest = (
        linked.select("id", F.when(F.col("aid").isNull(), F.col("parent")).alias("parent"), "name", "under")
        .unionByName(apart.where("parent is null").select("id", "parent", "name", F.lit(None).cast("bigint").alias("under")))
        .select("id", "parent", seg, F.lit(1).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("extra"), "under")
    )
    survivors, records = _rounds(forest, scratch, full=True)
    known = [scratch.save(survivors.select("id", F.col("id").alias("top"), "under", F.col("seg").alias("path"), F.col("w").alias("size")), "known")]

    def place(rec: DataFrame, resolved: DataFrame) -> DataFrame:
        above = resolved.select(F.col("id").alias("aid"), "top", F.col("under").alias("a_under"), F.col("path").alias("above"))
        return _meet_parents(rec, above, hot, "inner").select("id", "top", F.col("a_under").alias("under"), F.concat("above", "seg").alias("path"), "w", "extra", "child")

    for table in reversed(records):
        resolved = scratch.together(known)
        sizes = resolved.select(F.col("id").alias("cid"), F.col("size").alias("below"))
        spliced = place(table.where(F.col("out") == COMPRESSED).drop("under"), resolved).join(sizes, F.col("child") == F.col("cid"))
        known.append(scratch.save(spliced.select("id", "top", "under", "path", (F.col("w") + F.col("extra") + F.col("below")).alias("size")), "known"))
        # a leaf may hang below a node compressed in the same round
        leaves = place(table.where(F.col("out") == RAKED).drop("under"), scratch.together(known))
        known.append(scratch.save(leaves.select("id", "top", "under", "path", F.col("w").alias("size")), "known"))
    resolved = scratch.together(known)
    tree = F.col("under").isNull()
    none = F.lit(None).cast("bigint")
    out = resolved.select(
        "id",
        F.when(tree, F.lit("tree")).otherwise(F.lit("below_cycle")).alias("status"),
        F.when(tree, F.col("top")).alias("root_id"),
        F.when(tree, (F.size("path") - 1).cast("bigint")).alias("depth"),
        F.col("path.id").alias("path_ids"),
        F.col("path.name").alias("path_names"),
        F.col("under").alias("cycle_id"),
        (F.col("size") - 1).alias("n_descendants"),
    )
    ids, names = F.array().cast("array<bigint>"), F.lit(None).cast("array<string>")
    on_circles = circles.select(
        "id", F.lit("cycle").alias("status"), none.alias("root_id"), none.alias("depth"), ids.alias("path_ids"), names.alias("path_names"), "cycle_id", none.alias("n_descendants")
    )
    return out.unionByName(on_circles)


def descendants(full: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, distance: one row for each node and each node above it (circles aside)."""
    n = F.size("path_ids")
    return (
        full.where(n > 1)
        .select(F.col("id").alias("descendant_id"), n.alias("n"), F.posexplode("path_ids").alias("at", "ancestor_id"))
        .where("at < n - 1")
        .select("ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("at")).cast("bigint").alias("distance"))
    )

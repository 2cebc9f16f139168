"""Mixing sources to target weights by iterative proportional fitting.

Texts are sized in tokens of a public tokenizer and summed into cells (source, language, topic). The cells' weights are
raked in turn to the marginals of source (the targets), language and topic (their own shares among the sources that
have a target), never above a source's cap of repeats, until no weight changes by more than a millionth in a round; each
round ends with the sources, whose weights are scaled exactly under the cap, so their shares hold. A text of a
cell with weight r is taken floor(r) times, and once more with the probability of the rest: systematic sampling inside
bounded buckets of each source, corrected by single copies, so that the size of the sample hardly varies.

Defined results: names are compared trimmed and in lower case; sources that are null or without a target are left out;
a null language or topic is one called "unknown"; null, empty and token-free texts are never taken; the same text under
several ids or sources is one text (lowest id, first source by name); a target without any text has size, repeats and
share 0 and the other targets keep their proportions; an empty table gives an empty selection.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from cairn.llm.tokens import token_count
from cairn.session import Scratch

TOLERANCE = 1e-6  # the largest relative change of a weight in a round at which raking ends
MAX_ROUNDS = 60  # caps can keep languages and topics from their goals; then raking ends here at the latest
BUCKET_ROWS = 2000


def _plain(column: str) -> F.Column:
    return F.lower(F.trim(F.col(column)))


def _take(rows: pd.DataFrame) -> pd.DataFrame:
    """The copies of one bucket (about BUCKET_ROWS texts of a source).

    Systematic sampling in order of language, topic and size gives every text its calibrated chance; then single copies
    are added or taken back while that brings the tokens taken closer to those expected.
    """
    rows = rows.sort_values(["lang", "topic", "tokens", "dice", "doc_id"])
    r, tokens, cap = rows["r"].to_numpy(), rows["tokens"].to_numpy(), rows["cap"].to_numpy()
    upto = np.cumsum(r - np.floor(r)) + (int(rows["dice"].iloc[0]) % 1_000_003) / 1_000_003
    before = np.concatenate([[upto[0] - (r[0] - np.floor(r[0]))], upto[:-1]])
    copies = np.minimum(np.floor(r) + np.floor(upto + 1e-9) - np.floor(before + 1e-9), cap)
    over = copies @ tokens - r @ tokens
    for _ in range(100):
        change = np.where((copies > 0) & (over > 0), -tokens, np.where((copies < cap) & (over < 0) & (r > 0), tokens, 0))
        left = np.abs(over + change)
        best = int(left.argmin())
        if left[best] >= abs(over) - 1e-9:
            break
        copies[best] += np.sign(change[best])
        over += change[best]
    rows = rows.assign(copies=copies.astype(np.int32))
    return rows.loc[rows["copies"] > 0, ["doc_id", "source", "lang", "topic", "tokens", "copies"]]


def with_whole(rows: DataFrame, *totals: F.Column) -> DataFrame:
    """Every row beside totals over all rows."""
    return rows.crossJoin(F.broadcast(rows.agg(*totals)))  # one row


def under_cap(cells: DataFrame) -> DataFrame:
    """Each source's weights times one factor, but at most the cap, so that their tokens are the source's goal.

    In order of falling weight the first cells are at the cap and the rest are scaled to what is left; the first place
    from which on no scaled weight is above the cap tells where the one ends and the other begins.
    """
    down = Window.partitionBy("source").orderBy(F.desc("r"), "lang", "topic")
    before = F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("size") * F.col("r")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    cells = cells.withColumns({"place": F.row_number().over(down), "factor": F.when(rest > 0, (F.col("goal") - F.col("cap") * before) / rest)})
    fits = F.col("factor").isNotNull() & (F.col("r") * F.col("factor") <= F.col("cap") * (1 + 1e-12))
    factor = F.min(F.when(fits, F.struct("place", "factor"))).over(Window.partitionBy("source"))["factor"]
    scaled = F.when(factor.isNotNull(), F.least(F.col("r") * factor, F.col("cap").cast("double"))).otherwise(F.when(F.col("r") > 0, F.col("cap").cast("double")).otherwise(F.lit(0.0)))
    return cells.withColumn("r", scaled).drop("factor", "place")


class Mixture:
    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None):
        """docs: doc_id, text, source, lang, topic. targets: source, weight, max_repeats."""
        self.scratch = Scratch(docs.sparkSession, "mixing")
        goals = targets.where("source is not null and weight > 0").groupBy(_plain("source").alias("source")).agg(
            F.max("weight").cast("double").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")
        )
        self.goals = self.scratch.save(goals, "goals")
        rows = docs.select("doc_id", "text", _plain("source").alias("source"), F.coalesce(_plain("lang"), F.lit("unknown")).alias("lang"), F.coalesce(_plain("topic"), F.lit("unknown")).alias("topic"))
        rows = rows.join(self.goals.select("source"), "source", "left_semi").where("text is not null and text <> ''")
        first = F.min(F.struct("source", "doc_id", "lang", "topic")).alias("f")
        # one row for each distinct text; its hash and length stand for it
        texts = rows.groupBy(F.xxhash64("text").alias("h1"), F.sha1("text").alias("h2")).agg(first, F.first("text").alias("text"))
        sized = texts.select("f.*", token_count("text").alias("tokens")).where("tokens > 0")
        self.texts = self.scratch.save(sized, "texts")
        sizes = self.texts.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n_texts"))
        full = self.goals.join(sizes, "source", "left").fillna({"size": 0, "n_texts": 0})
        alive = F.when(F.col("size") > 0, F.col("weight"))
        full = with_whole(full, F.sum(alive).alias("all_weight")).withColumn("share", alive / F.col("all_weight")).drop("all_weight")
        # the largest total at which every target can be met under its cap
        full = with_whole(full, F.min(F.col("size") * F.col("cap") / F.col("share")).alias("total"))
        total = F.col("total") if total_tokens is None else F.least("total", F.lit(float(total_tokens)))
        self.plan = self.scratch.save(full.withColumn("goal", F.coalesce(total * F.col("share"), F.lit(0.0))).drop("total"), "plan")
        self.cells = self._rake()

    def _rake(self) -> DataFrame:
        """source, lang, topic, r: how often a text of the cell is wanted."""
        cells = self.texts.groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("size"))
        cells = cells.join(self.plan.select("source", "cap", "goal"), "source").withColumn("r", F.lit(1.0))
        cells = with_whole(cells, F.sum("size").alias("everything"))
        wanted = self.plan.agg(F.sum("goal").alias("all"))
        cells = cells.crossJoin(F.broadcast(wanted))  # one row of one number
        for name in ("lang", "topic"):
            own = F.sum("size").over(Window.partitionBy(name))
            cells = cells.withColumn(f"{name}_goal", own / F.col("everything") * F.col("all"))
        cells = self.scratch.save(cells.drop("everything", "all"), "cells")
        for _ in range(MAX_ROUNDS):
            seen = Observation()
            moved = cells.withColumn("before", F.col("r"))
            for name in ("topic", "lang"):
                now = F.sum(F.col("size") * F.col("r")).over(Window.partitionBy(name))
                scaled = F.when(now > 0, F.col("r") * F.col(f"{name}_goal") / now).otherwise(F.lit(0.0))
                moved = moved.withColumn("r", F.least(scaled, F.col("cap").cast("double")))
            moved = under_cap(moved)
            change = F.abs(F.col("r") - F.col("before")) / F.greatest("before", F.lit(1e-12))
            cells = self.scratch.save(moved.observe(seen, F.max(change).alias("change")).drop("before"), "cells")
            if (seen.get["change"] or 0.0) <= TOLERANCE:
                break
        return cells.select("source", "lang", "topic", "r", "cap")

    def selection(self) -> DataFrame:
        """doc_id, source, lang, topic, tokens, copies of the texts taken at least once."""
        rows = self.texts.join(F.broadcast(self.plan.select("source", "n_texts")), "source")
        rows = rows.join(self.cells, ["source", "lang", "topic"])
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_texts") / BUCKET_ROWS)))
        rows = rows.select("doc_id", "source", "lang", "topic", "tokens", "r", "cap", F.xxhash64("doc_id", F.lit(11)).alias("dice"), "bucket")
        schema = "doc_id long, source string, lang string, topic string, tokens long, copies int"
        return rows.groupBy("source", "bucket").applyInPandas(_take, schema)

    def report(self) -> DataFrame:
        """One row a target: its texts and tokens, target share, mean repeats, tokens taken and share reached."""
        got = self.selection().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most"))
        rows = self.plan.join(got, "source", "left").fillna({"taken": 0, "most": 0})
        all_taken = F.col("all_taken")
        return with_whole(rows, F.sum("taken").alias("all_taken")).select(
            "source", "n_texts", F.col("size").alias("size_tokens"), F.col("weight").alias("target_share"), F.col("cap").alias("max_repeats"), F.col("most").alias("repeats"),
            F.round(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0), 4).alias("mean_repeats"), F.col("taken").alias("taken_tokens"),
            F.round(F.when(all_taken > 0, F.col("taken") / all_taken).otherwise(0.0), 6).alias("actual_share"),
        )

    def marginals(self) -> DataFrame:
        """Shares of tokens by language and topic, among all texts with a target and in the selection."""
        made = None
        for name in ("lang", "topic"):
            have = self.texts.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("have"))
            took = self.selection().groupBy(F.col(name).alias("value")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("took"))
            part = with_whole(have.join(took, "value", "left").fillna({"took": 0}), F.sum("have").alias("all_have"), F.sum("took").alias("all_took"))
            part = part.select(F.lit(name).alias("marginal"), "value", F.round(F.col("have") / F.col("all_have"), 6).alias("wanted_share"), F.round(F.col("took") / F.col("all_took"), 6).alias("actual_share"))
            made = part if made is None else made.unionByName(part)
        return made

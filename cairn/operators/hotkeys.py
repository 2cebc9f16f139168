"""Figures per key where a few keys hold most rows.

Everything starts from one mergeable histogram: how often each key has each value (no value is one, too). Row counts,
means and the keys that hold a large share of all rows are sums over it; distinct sources are a grouped aggregate that
Spark combines before it shuffles. Quantiles are selected exactly by refining coarser histograms: all keys' value ranges
are cut into bins, only (key, quantile, bin) counts are merged, the bin that holds the wanted rank becomes the next range,
and this goes on until a range is one value. The first bins are powers of two, all later ones lie within one, where numbers
are evenly spaced; so eleven turns are enough whatever the values. The values of a key are never gathered; those of keys
with more than 1/200 of all values are spread over salts (there can be at most 200 of them).

Defined results: rows with a null key are left out; null and NaN values count as rows but not in mean or quantiles
(null if a key has no other value); infinite values are ordered as usual; null sources aren't counted as distinct;
repeated rows count as often as they come. The q-quantile is the value at rank ceil(q * n), counted from one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from cairn.session import Scratch

BINS = 64
SALTS = 16
HEAVY_SHARE = 200


def _usable(value: str) -> F.Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value))


def _binade(v: F.Column) -> F.Column:
    """The power of two a number lies at, in the order of the numbers."""
    power = F.greatest(F.least(F.floor(F.log2(F.abs(v))), F.lit(1024)), F.lit(-1080)) + 2000
    return F.when(v == 0, F.lit(0)).when(v > 0, power).otherwise(-power)


def _bin(v: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
    """Both ends of a range have a bin of their own, so every turn takes at least one value off each end."""
    inner = F.when(_binade(lo) == _binade(hi), F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1))).otherwise(_binade(v))
    return F.when(v == lo, F.lit(-10_000)).when(v == hi, F.lit(10_000)).otherwise(inner).cast("int")


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """key (string), v, c: how often each key comes with each usable value, or with none (null)."""
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).cast("string").alias("key"), F.when(v.isNotNull() & ~F.isnan(v), v).alias("v")).where("key is not null")
    return rows.groupBy("key", "v").agg(F.count(F.lit(1)).alias("c"))


def select_quantiles(values: DataFrame, quantiles: Sequence[float], scratch: Scratch) -> DataFrame:
    """key, q, value from (key, v, c), the counts of each key's values."""
    seen = Observation()
    per_key = values.groupBy("key").agg(
        F.sum("c").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n_values")
    )
    per_key = scratch.save(per_key.observe(seen, F.sum("n_values").alias("all_values")), "keys")
    bound = (seen.get["all_values"] or 0) / HEAVY_SHARE
    heavy = per_key.where(F.col("n_values") > F.lit(bound) + SALTS).select("key", F.lit(True).alias("heavy"))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    state = per_key.select("key", "total", "lo", "hi", qs.alias("q")).select(
        "key", "q", "lo", "hi", F.greatest(F.ceil(F.col("q") * F.col("total")), F.lit(1)).alias("rank")
    )
    spread = values.join(F.broadcast(heavy), "key", "left").select(
        "key", "v", "c", F.when(F.col("heavy"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")
    )
    solved, turn = [], 0
    while True:
        solved.append(state.where("lo = hi").select("key", "q", F.col("lo").alias("value")))
        open_ = state.where("lo < hi")
        if turn and not left:  # noqa: F821
            break
        turn += 1
        salts = F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        ranges = open_.join(F.broadcast(heavy), "key", "left").select("key", "q", "lo", "hi", "rank", salts.alias("salt"))
        bins = (
            spread.join(ranges, ["key", "salt"])
            .where("v between lo and hi")
            .groupBy("key", "q", "rank", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
            .agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        upto = F.sum("n").over(Window.partitionBy("key", "q").orderBy("bin"))
        step = Observation()
        nxt = (
            bins.withColumn("upto", upto)
            .where("upto >= rank and upto - n < rank")
            .select("key", "q", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
            .observe(step, F.count_if(F.col("lo") < F.col("hi")).alias("left"))
        )
        state = scratch.save(nxt, "ranges")
        left = step.get["left"]
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out


def key_figures(
    df: DataFrame, key: str, source: str, value: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """key (string), n_rows, n_sources, mean_value and one column p25, p50, ... for each quantile."""
    scratch = Scratch(df.sparkSession, "hotkeys")
    values = scratch.save(histogram(df, key, value), "values")
    counts = values.groupBy("key").agg(
        F.sum("c").alias("n_rows"), (F.sum(F.col("v") * F.col("c")) / F.sum(F.when(F.col("v").isNotNull(), F.col("c")))).alias("mean_value")
    )
    sources = df.select(F.col(key).cast("string").alias("skey"), F.col(source).alias("src")).where("skey is not null")
    sources = sources.groupBy("skey").agg(F.countDistinct("src").alias("n_sources"))
    chosen = select_quantiles(values.where("v is not null"), quantiles, scratch)
    wide = chosen.groupBy("key").agg(
        *[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(f"p{round(q * 100)}") for q in quantiles]
    )
    out = counts.join(sources, F.col("key") == F.col("skey"), "left").join(wide, "key", "left")
    return out.select("key", "n_rows", "n_sources", "mean_value", *[f"p{round(q * 100)}" for q in quantiles])


def heavy_keys(values: DataFrame, delivered: DataFrame, share: float) -> DataFrame:
    """key, n_rows of the keys with at least ``share`` of the rows delivered, those without a key included.

    values: a histogram of the same rows. There can be at most 1 / share such keys.
    """
    total = delivered.agg(F.count(F.lit(1)).alias("total_rows"))
    counts = values.groupBy("key").agg(F.sum("c").alias("n_rows"))
    # one row with one number
    return counts.crossJoin(F.broadcast(total)).where(F.col("n_rows") >= F.col("total_rows") * F.lit(share)).select("key", "n_rows")


def heavy_figures(
    df: DataFrame, key: str, source: str, value: str, share: float, quantiles: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """What ``key_figures`` gives, for the keys with at least ``share`` of the rows delivered only."""
    heavy = heavy_keys(histogram(df, key, value), df, share).select(F.col("key").alias("heavy_key"))
    heavy = Scratch(df.sparkSession, "heavy").save(heavy, "keys")
    # at most 1 / share keys
    return key_figures(df.join(F.broadcast(heavy), F.col(key).cast("string") == F.col("heavy_key"), "left_semi"), key, source, value, quantiles)

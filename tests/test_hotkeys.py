import math
import random

from cairn.operators.hotkeys import heavy_keys, histogram, key_figures


def figures(spark, rows, quantiles=(0.25, 0.5, 0.75)):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "k string, s long, c double, v int, key string")
    return {r["key"]: r for r in key_figures(df, "k", "s", "c", quantiles).collect()}


def rank(values, q):
    values = sorted(values)
    return values[max(math.ceil(q * len(values)), 1) - 1]


def test_exact_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", rng.randrange(40), rng.choice([rng.random(), rng.expovariate(1e-3), 0.5, -rng.random()])) for _ in range(4000)]
    got = figures(spark, rows)
    by = {}
    for k, s, c in rows:
        by.setdefault(k, []).append((s, c))
    assert set(got) == set(by)
    for k, pairs in by.items():
        values = [c for _, c in pairs]
        assert got[k]["n_rows"] == len(pairs) and got[k]["n_sources"] == len({s for s, _ in pairs})
        assert [got[k][p] for p in ("p25", "p50", "p75")] == [rank(values, q) for q in (0.25, 0.5, 0.75)]
        assert abs(got[k]["mean_value"] - sum(values) / len(values)) < 1e-6


def test_odd_values(spark):
    inf = float("inf")
    got = figures(spark, [("a", 1, None), ("a", None, float("nan")), ("b", 1, inf), ("b", 1, -inf), ("b", 2, 1.7e308), ("b", 2, 1.0), (None, 1, 1.0), ("c", 1, 2.0), ("c", 1, 2.0)])
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["n_rows"] == 2 and got["a"]["n_sources"] == 1 and got["a"]["p50"] is None
    assert (got["b"]["p25"], got["b"]["p50"], got["b"]["p75"]) == (-inf, 1.0, 1.7e308)
    assert got["c"]["p50"] == 2.0 and got["c"]["n_rows"] == 2


def test_values_over_many_orders_of_magnitude(spark):
    rng = random.Random(9)
    values = [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1060, 1020) for _ in range(3000)] + [0.0, -0.0, 5e-324]
    got = figures(spark, [("k", i, v) for i, v in enumerate(values)], (0.01, 0.25, 0.5, 0.99))["k"]
    assert [got[p] for p in ("p1", "p25", "p50", "p99")] == [rank(values, q) for q in (0.01, 0.25, 0.5, 0.99)]


def test_empty_and_heavy(spark):
    assert figures(spark, []) == {}
    rows = [("a", None)] * 49 + [("a", 1.0)] * 48 + [("b", float("nan"))] * 2 + [("c", 2.0)] + [(None, 2.0)] * 0
    df = spark.createDataFrame([(k, v, 5) for k, v in rows], "k string, v double, n_rows long")
    assert {(r["key"], r["n_rows"]) for r in heavy_keys(histogram(df, "k", "v"), df, 0.02).collect()} == {("a", 97), ("b", 2)}
    more = df.unionByName(spark.createDataFrame([(None, 1.0, 5)] * 20, df.schema))
    assert {r["key"] for r in heavy_keys(histogram(more, "k", "v"), more, 0.02).collect()} == {"a"}
    assert heavy_keys(histogram(df.limit(0), "k", "v"), df.limit(0), 0.02).count() == 0


def test_found_keys_come_with_all_their_figures(spark, tmp_path, monkeypatch):
    from cairn.operators import hotkeys
    from cairn.plans.data_queries import p3_found

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(400)}", rng.randrange(40), rng.choice([rng.random(), None])) for _ in range(3000)] + [(None, 1, 0.5)] * 20
    spark.createDataFrame(rows, "name string, file_id long, confidence double").write.parquet(f"{tmp_path}/occurrences.parquet")
    spark.createDataFrame(rows, "dst_symbol_id string, src_symbol_id long, confidence double").write.parquet(f"{tmp_path}/edges.parquet")
    selected = []
    real = hotkeys.select_quantiles
    monkeypatch.setattr(hotkeys, "select_quantiles", lambda values, *more: selected.append({r["key"] for r in values.select("key").distinct().collect()}) or real(values, *more))
    assert {tuple(r) for r in p3_found(spark, str(tmp_path)).collect()} == {("edges", "hot"), ("occurrences", "hot")}
    assert selected == [{"hot"}, {"hot"}]
    df = spark.createDataFrame(rows, "k string, s long, c double")
    got = {r["key"]: r for r in hotkeys.heavy_figures(df, "k", "s", "c", 0.02).collect()}
    values = [v for k, _, v in rows if k == "hot" and v is not None]
    assert set(got) == {"hot"} and got["hot"]["n_rows"] == sum(k == "hot" for k, *_ in rows)
    assert [got["hot"][p] for p in ("p25", "p50", "p75")] == [rank(values, q) for q in (0.25, 0.5, 0.75)]

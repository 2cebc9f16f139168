import random

from cairn.llm.mixing import Mixture


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shares_caps_and_copies(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for i in range(1200):
        source = rng.choice(["Big ", "big", "big", "small", None, "none"]) if i % 9 else "small"
        rows.append((i, " ".join(rng.choice(words) + str(i) for _ in range(rng.randrange(3, 40))), source, rng.choice(["en", " EN", "de", None]), rng.choice(["a", "b", None])))
    rows += [(5000, rows[1][1], "big", "en", "a"), (5001, None, "big", "en", "a"), (5002, "", "small", "en", "a")]
    m = Mixture(docs(spark, rows), targets(spark, [("big", 0.5, 1), ("SMALL", 0.4, 3), ("gone", 0.1, 2)]))
    report = {r["source"]: r for r in m.report().collect()}
    assert abs(report["big"]["actual_share"] - 5 / 9) < 0.01 and abs(report["small"]["actual_share"] - 4 / 9) < 0.01
    assert report["gone"]["taken_tokens"] == 0 and report["gone"]["actual_share"] == 0
    taken = m.selection().collect()
    assert len({r["doc_id"] for r in taken}) == len(taken) and not {5001, 5002} & {r["doc_id"] for r in taken}
    assert all(1 <= r["copies"] <= {"big": 1, "small": 3}[r["source"]] for r in taken)
    shares = {(r["marginal"], r["value"]): r["actual_share"] for r in m.marginals().collect()}
    assert ("lang", "unknown") in shares and abs(sum(v for (k, _), v in shares.items() if k == "lang") - 1) < 1e-4


def test_total_can_be_smaller(spark):
    rows = [(i, f"word{i} and more text", "a" if i % 2 else "b", "en", "t") for i in range(400)]
    m = Mixture(docs(spark, rows), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), total_tokens=600)
    assert abs(sum(r["tokens"] * r["copies"] for r in m.selection().collect()) - 600) < 20


def test_empty(spark):
    m = Mixture(docs(spark, []), targets(spark, [("a", 1.0, 1)]))
    assert m.selection().count() == 0
    assert [r["actual_share"] for r in m.report().collect()] == [0.0]


def test_weights_under_a_cap(spark):
    from cairn.llm.mixing import under_cap

    rows = [("a", "x", "t", 100.0, 3.0, 2, 250.0), ("a", "y", "t", 50.0, 1.0, 2, 250.0), ("a", "z", "t", 10.0, 0.0, 2, 250.0), ("b", "x", "t", 10.0, 1.0, 1, 50.0), ("c", "x", "t", 10.0, 0.0, 1, 5.0), ("d", "x", "t", 8.0, 0.5, 4, 6.0)]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, size double, r double, cap int, goal double")
    got = {(r["source"], r["lang"]): r["r"] for r in under_cap(df).collect()}
    assert got == {("a", "x"): 2.0, ("a", "y"): 1.0, ("a", "z"): 0.0, ("b", "x"): 1.0, ("c", "x"): 0.0, ("d", "x"): 0.75}

from cairn.operators.graph import walk
from cairn.session import Scratch


def test_walk_levels_and_parents(spark):
    rows = [(1, 2, 0.5), (1, 3, 0.9), (2, 4, 0.7), (3, 4, 0.7), (4, 1, 1.0), (4, 4, 1.0), (5, 6, 1.0), (None, 7, 1.0)]
    edges = spark.createDataFrame(rows, "at long, to long, weight double")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    out = {r["node"]: (r["depth"], r["via"]) for r in walk(edges, seeds, 6, Scratch(spark, "t")).collect()}
    assert out == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 2)}
    near = walk(edges, seeds, 1, Scratch(spark, "t")).count()
    assert near == 3


def test_walk_without_seeds(spark):
    edges = spark.createDataFrame([], "at long, to long, weight double")
    assert walk(edges, spark.createDataFrame([], "node long"), 3, Scratch(spark, "t")).count() == 0


def test_shortest_paths(spark):
    from cairn.operators.graph import shortest_paths
    from cairn.session import Scratch

    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 4, 0.9), (3, 4, 0.5), (4, 5, 1.0), (5, 1, 1.0), (6, 6, 1.0), (None, 2, 1.0)], "at long, to long, weight double")
    pairs = spark.createDataFrame([(1, 5), (1, 5), (1, 1), (2, 3), (6, 1), (9, 9), (None, 1)], "source_id long, target_id long")
    got = {(r["source_id"], r["target_id"]): (r["steps"], r["path"]) for r in shortest_paths(edges, pairs, 4, Scratch(spark, "t")).collect()}
    assert got == {(1, 5): (3, "1>2>4>5"), (1, 1): (0, "1"), (2, 3): (4, "2>4>5>1>3"), (9, 9): (0, "9")}

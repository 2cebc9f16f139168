import random

from cairn.operators import hierarchy as h

SCHEMA = "symbol_id long, parent_symbol_id long, name string, id long, parent string, seg int"


def frame(spark, rows):
    """Rows (id, parent, name) with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, p, n, 7, "x", 1) for i, p, n in rows], SCHEMA)


def run(spark, rows):
    done = h.contract(frame(spark, rows), "symbol_id", "parent_symbol_id", "name")
    full = {r["id"]: r for r in h.expand(done).collect()}
    circles = {r["id"]: r["cycle_id"] for r in h.cycle_members(done).collect()}
    return full, circles


def brute(rows):
    parent = {}
    for i, p, _ in rows:
        if i is not None:
            parent[i] = p if i not in parent or (p is not None and (parent[i] is None or p < parent[i])) else parent[i]
    parent = {i: (p if p in parent else None) for i, p in parent.items()}
    out = {}
    for i in parent:
        chain, cur = [i], parent[i]
        while cur is not None and cur not in chain:
            chain.append(cur)
            cur = parent[cur]
        out[i] = ("tree", chain[-1], len(chain) - 1) if cur is None else ("cycle" if cur == i else "below_cycle", None, None)
    return out


def test_trees_chains_and_circles(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, None), (4, 99, "d"), (5, 5, "self"), (6, 7, "x"), (7, 8, "y"), (8, 6, "z"), (9, 6, "hang"), (10, 9, "lower"), (2, 1, "b"), (None, 1, "no id")]
    full, circles = run(spark, rows)
    assert full[3]["path_names"] == ["a", "b", ""] and full[3]["depth"] == 2 and full[3]["root_id"] == 1
    assert full[4]["status"] == "tree" and full[4]["depth"] == 0
    assert circles == {5: 5, 6: 6, 7: 6, 8: 6}
    assert full[10]["status"] == "below_cycle" and full[10]["path_ids"] == [9, 10] and full[10]["cycle_id"] == 6
    assert full[7]["status"] == "cycle" and full[7]["depth"] is None
    assert set(full) == set(range(1, 11))


def test_random_forest_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.randrange(1, 301), i - 1 if i > 1 else None, 400]), f"n{i}") for i in range(1, 301)]
    full, circles = run(spark, rows)
    want = brute(rows)
    assert {i: (r["status"], r["root_id"], r["depth"]) for i, r in full.items()} == want
    assert set(circles) == {i for i, (s, _, _) in want.items() if s == "cycle"}


def test_descendants_and_counts(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d")]
    full = h.expand(h.contract(frame(spark, rows), "symbol_id", "parent_symbol_id", "name"))
    pairs = {tuple(r) for r in h.descendants(full).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 4, 1)}
    assert {r["id"]: r["n_descendants"] for r in full.collect()} == {1: 3, 2: 1, 3: 0, 4: 0}


def test_star_long_chain_and_large_circle(spark):
    n = 400
    chain = [(i, i - 1 if i > 1 else None, f"c{i}") for i in range(1, n + 1)]
    star = [(1000 + i, 1000 if i else None, None) for i in range(600)]
    circle = [(2000 + i, 2000 + (i + 1) % 300, "o") for i in range(300)] + [(3000 + i, 2007, "h") for i in range(200)]
    full, circles = run(spark, chain + star + circle)
    assert circles == {2000 + i: 2000 for i in range(300)}
    assert all(full[i]["depth"] == i - 1 and full[i]["n_descendants"] == n - i and full[i]["path_ids"] == list(range(1, i + 1)) for i in range(1, n + 1))
    assert full[1000]["n_descendants"] == 599 and full[1599]["depth"] == 1
    assert all(full[3000 + i]["cycle_id"] == 2000 and full[3000 + i]["status"] == "below_cycle" and full[3000 + i]["n_descendants"] == 0 for i in range(200))


def test_empty(spark):
    full, circles = run(spark, [])
    assert full == {} and circles == {}

import numpy as np

from cairn.llm import vectors as v

SCHEMA = "chunk_id long, embedding array<float>, id string, rep int"


def make(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if e is None else float(e) for e in x], "z", 1) for i, x in rows], SCHEMA)


def sample(n=900, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, 64))
    x = centres[rng.integers(0, 30, n)] + 0.8 * rng.standard_normal((n, 64))
    x[n // 2 : n // 2 + 40] = x[:40] + 0.05 * rng.standard_normal((40, 64))
    x[-5:] = x[7]
    return x.astype(np.float32)


def brute(x, ids):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


def test_pairs_and_recall_against_brute_force(spark):
    x = sample()
    ids = np.arange(1, len(x) + 1)
    df = make(spark, list(zip(ids.tolist(), x.tolist())))
    g = brute(x, ids)
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(g >= 0.95)) if i < j}
    got = {(r["id_a"], r["id_b"]) for r in v.similar_pairs(df, "chunk_id", "embedding", 0.95).collect()}
    assert got == want
    near = {}
    for r in v.nearest_rows(df, "chunk_id", "embedding", 10).collect():
        near.setdefault(r["id"], []).append(r["neighbour_id"])
    np.fill_diagonal(g, -2)
    top = np.argsort(-g, axis=1, kind="stable")[:, :10]
    hits = np.mean([len(set(near[i]) & set(ids[t])) / 10 for i, t in zip(ids, top)])
    assert hits >= 0.9 and all(len(n) == 10 for n in near.values())


def test_lists_are_probed(spark):
    x = sample(1200, 3)
    ids = np.arange(1, len(x) + 1)
    rows = v.usable(make(spark, list(zip(ids.tolist(), x.tolist()))), "chunk_id", "embedding")
    lists = v.ProbedLists(rows, list_rows=150, n_probe=6)
    assert lists.n_lists > 5
    near = {}
    for r in lists.nearest(10).collect():
        near.setdefault(r["qid"], set()).add(r["rep"])
    g = brute(x, ids)
    np.fill_diagonal(g, -2)
    keep = [i for i in ids if i in near]
    place = {i: k for k, i in enumerate(keep)}
    sub = g[np.ix_(np.array(keep) - 1, np.array(keep) - 1)]
    top = np.argsort(-sub, axis=1)[:, :10]
    assert np.mean([len(near[i] & {keep[t] for t in top[place[i]]}) / 10 for i in keep]) >= 0.9


def test_unusable_rows_and_empty(spark):
    one = [1.0] + [0.0] * 63
    rows = [(1, one), (2, None), (3, [0.0] * 64), (4, [1.0] * 63), (5, [float("nan")] + [1.0] * 63), (6, [None] + [1.0] * 63), (7, [2.0] + [0.0] * 63), (1, one), (None, one), (8, [float("inf")] + [1.0] * 63)]
    df = make(spark, rows)
    assert {tuple(r) for r in v.similar_pairs(df, "chunk_id", "embedding", 0.95).collect()} == {(1, 7)}
    assert [(r["id"], r["neighbour_id"]) for r in v.nearest_rows(df, "chunk_id", "embedding", 10).orderBy("id").collect()] == [(1, 7), (7, 1)]
    assert v.similar_pairs(make(spark, []), "chunk_id", "embedding", 0.95).count() == 0
    assert v.nearest_rows(make(spark, []), "chunk_id", "embedding", 10).count() == 0


def test_scan_keeps_what_a_full_scan_finds():
    x = sample(400, 5)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) @ v.rotation(64)
    a, b, c = v.scan_block(u[:50], np.arange(50), np.full(50, 0.1, np.float32), u, np.arange(400), 0, 3.0)
    g = u[:50].astype(float) @ u.T.astype(float)
    want = {(i, j) for i, j in zip(*np.nonzero(2 - 2 * g <= 0.1)) if i != j}
    assert set(zip(a, b)) >= {p for p in want if g[p] > 0.951}


def test_exact_searches_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(v, "LIST_ROWS", 60)
    x = sample(500, 11)
    ids = np.arange(1, len(x) + 1)
    df = make(spark, list(zip(ids.tolist(), x.tolist())))
    g = brute(x, ids)
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(g >= 0.8)) if i < j}
    rows = v.usable(df, "chunk_id", "embedding")
    lists = v.ProbedLists(rows, list_rows=60, exact=True)
    reps = {(r["rep_a"], r["rep_b"]) for r in lists.within(0.8).collect()}
    rep = {r["rep"] for r in lists.reps.collect()}
    assert lists.n_lists > 5 and reps == {p for p in want if set(p) <= rep}
    near = {(r["qid"], r["rep"]) for r in lists.nearest(5).collect()}
    keep = np.array(sorted(rep)) - 1
    sub = g[np.ix_(keep, keep)]
    np.fill_diagonal(sub, -2)
    assert near == {(keep[i] + 1, keep[j] + 1) for i in range(len(keep)) for j in np.argsort(-sub[i], kind="stable")[:5]}


def test_a_third_of_all_vectors_are_copies(spark, monkeypatch):
    monkeypatch.setattr(v, "COPY_ROWS", 20)
    x = sample(240, 12)
    x[:80] = x[0]
    x[80:83] = x[0] * 3 + 0.01
    ids = np.arange(1, len(x) + 1)
    df = make(spark, list(zip(ids.tolist(), x.tolist())))
    g = brute(x, ids)
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(g >= 0.95)) if i < j}
    got = [(r["id_a"], r["id_b"]) for r in v.similar_pairs(df, "chunk_id", "embedding", 0.95).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {r["id"]: r for r in v.similar_links(df, "chunk_id", "embedding", 0.95).collect()}
    assert all(links[i]["n_links"] == sum(i in p for p in want) for i in ids) and links[80]["class_id"] == 1 and links[80]["n_copies"] == 80
    near = {}
    for r in v.nearest_rows(df, "chunk_id", "embedding", 10).collect():
        near.setdefault(r["id"], []).append(r["neighbour_id"])
    assert near[1] == list(range(2, 12)) and near[80] == list(range(1, 11)) and near[5] == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]

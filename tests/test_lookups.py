import random

from cairn.operators import chunks, lookups
from pyspark.sql import functions as F


def runs(text):
    w = "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text.lower()).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) for _ in range(120)]
    for i in range(60, 120):
        words = texts[i - 60].split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[i] = " ".join(words)
    texts += [texts[0]] * 40 + ["", "one two three", None, "A b-c D e F g " * 5000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, "a b c d e f", "x")], "id long, text string, class_id string")
    members, pairs = chunks.near_copies(df, "id", "text", 0.8)
    classes = {r["id"]: r["class_id"] for r in members.collect()}
    near = {(r["a"], r["b"]) for r in pairs.collect()}
    sets = {i: runs(t) for i, t, _ in rows if t and runs(t)}
    ids = sorted(sets)
    assert set(classes) == set(ids)
    for i in ids:
        for j in ids:
            if i < j:
                linked = classes[i] == classes[j] or tuple(sorted((classes[i], classes[j]))) in near
                assert linked == (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8), (i, j)
    empty = chunks.near_copies(df.limit(0), "id", "text")
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_names_holding(spark):
    names = spark.createDataFrame([("loadIndex",), ("INDEX",), (None,), ("a%b",), ("ab",), ("Éclair",), ("index",)], "name string")
    phrases = spark.createDataFrame([("index",), ("%",), ("a%",), ("zzz",), ("",), (None,), ("É",), ("é",), ("IN",)], "phrase string")
    got = {(r["phrase"], r["name"]) for r in chunks.names_holding(names, phrases).collect()}
    assert got == {("index", "loadIndex"), ("index", "INDEX"), ("index", "index"), ("%", "a%b"), ("a%", "a%b"), ("É", "Éclair"), ("IN", "loadIndex"), ("IN", "INDEX"), ("IN", "index")}
    assert chunks.names_holding(names, phrases.limit(0)).count() == 0


class Fixture:
    """An index of a few rows."""

    def __init__(self, spark, **tables):
        schemas = {
            "files": "file_id long, path string, lang string, is_test boolean",
            "symbols": "symbol_id long, file_id long, name string, kind string, start_line int, end_line int",
            "imports": "import_id long, file_id long, resolved_file_id long",
            "occurrences": "occ_id long, file_id long, name string, role string, start_line int, start_col int, resolved_symbol_id long, confidence double",
            "edges": "src_symbol_id long, dst_symbol_id long, kind string, confidence double, provenance string",
        }
        self.spark = spark
        for name, schema in schemas.items():
            setattr(self, name, spark.createDataFrame(tables.get(name, []), schema))


def fixture(spark):
    return Fixture(
        spark,
        files=[(1, "r/a.py", "python", False), (2, "r/b.py", "python", False)],
        symbols=[(10, 1, "f", "function", 1, 9), (20, 2, "f", "function", 1, 9), (21, 2, "g", "function", 10, 19)],
        imports=[(1, 1, 2), (2, 2, 1), (3, 1, None)],
        occurrences=[(1, 1, "g", "call", 2, 0, 21, 0.9), (2, 2, "f", "call", 12, 0, 10, 0.9), (3, 2, "f", "ref", 13, 0, None, None), (4, 1, None, "ref", 3, 0, None, None)],
        edges=[(10, 21, "calls", 0.9, "index"), (21, 10, "calls", 0.9, "index"), (20, 21, "calls", 0.5, "lsp"), (None, 21, "calls", None, None)],
    )


def test_references_and_neighbours(spark):
    ix = fixture(spark)
    rows = [(r["symbol_id"], r["rank"], r["occ_id"], r["is_resolved"]) for r in lookups.reference_rows(ix, 2).orderBy("symbol_id", "rank").collect()]
    assert rows == [(10, 1, 2, True), (10, 2, 3, False), (20, 1, 3, False), (21, 1, 1, True)]
    near = [(r["symbol_id"], r["direction"], r["rank"], r["other_id"]) for r in lookups.neighbours(ix, 1).collect()]
    assert (21, "in", 1, 10) in near and not [n for n in near if n[2] > 1]
    assert {tuple(r) for r in lookups.call_sites(ix).collect()} == {(10, 21, 1, 2), (21, 10, 1, 12)}
    assert lookups.reference_rows(Fixture(spark)).count() == 0


def test_removing_a_file(spark):
    left = lookups.without_files(fixture(spark), spark.createDataFrame([(2,), (2,), (None,)], "file_id long"))
    assert [r["symbol_id"] for r in left["symbols"].collect()] == [10] and [r["file_id"] for r in left["files"].collect()] == [1]
    assert {(r["import_id"], r["resolved_file_id"]) for r in left["imports"].collect()} == {(1, None), (3, None)}
    assert {(r["occ_id"], r["resolved_symbol_id"]) for r in left["occurrences"].collect()} == {(1, None), (4, None)}
    assert left["edges"].count() == 0


def test_levels_show_each_symbol_once(spark):
    edges = [(2, 1, "calls", 0.9, "x"), (3, 1, "calls", 0.8, "x"), (3, 2, "calls", 0.9, "x"), (1, 3, "calls", 0.9, "x"), (4, 3, "calls", 0.1, "x"), (5, 3, "calls", 0.2, "x"), (6, 3, "calls", 0.3, "x")]
    ix = Fixture(spark, symbols=[(i, 1, f"n{i}", "function", 1, 2) for i in range(1, 7)], edges=edges)
    seeds = spark.createDataFrame([(1,), (1,)], "symbol_id long")
    out = {(r["depth"], r["parent_id"], r["symbol_id"]) for r in lookups.hierarchy_levels(ix, seeds, ["calls"], 3, 2).collect()}
    assert out == {(1, 1, 2), (1, 1, 3), (2, 3, 6)}


def test_resolution_pass(spark):
    ix = fixture(spark)
    scope = ix.files.where("file_id = 1").select("file_id")
    fresh = ix.edges.where("src_symbol_id = 21").withColumn("src_symbol_id", F.lit(10).cast("long"))
    out = {(r[0], r[1], r[4]) for r in lookups.resolution_pass(ix, scope, fresh).collect()}
    assert out == {(10, 10, "index"), (21, 10, "index"), (20, 21, "lsp"), (None, 21, None)}

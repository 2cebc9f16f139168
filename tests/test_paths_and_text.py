import pytest
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.relational import upsert_edges
from cairn.operators.resolution import promote_edges
from cairn.operators.retrieval import estimated_tokens, fuse, within_budget


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [("a/./b//c", "a/b/c"), ("a/../../b", "b"), ("../x", "x"), ("", ""), ("a/b/..", "a")])
def test_normalize(spark, given, wanted):
    assert value(spark, paths.normalize_path(F.lit(given))) == wanted


def test_path_parts(spark):
    p = F.lit("r/src/a.b/File.Test.TS")
    assert value(spark, paths.parent_dir(p)) == "r/src/a.b"
    assert value(spark, paths.base_name(p)) == "File.Test.TS"
    assert value(spark, paths.extension(p)) == ".ts"
    assert value(spark, paths.extension(F.lit("a.b/none"))) == ""
    assert value(spark, paths.path_suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]
    assert value(spark, paths.path_ancestors(F.lit("a/b/c"))) == ["a/b", "a", ""]
    assert value(spark, paths.tail(F.lit("res://" + "a" * 200_000), 7)) == "a" * 200_000


@pytest.mark.parametrize("text, n", [("", 0), ("abcd", 2), ("x" * 37, 10), ("a  \n b", 1), (None, 0)])
def test_estimated_tokens(spark, text, n):
    assert value(spark, estimated_tokens(F.lit(text).cast("string"))) == n


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 10), (2, 1, 3), (2, 2, 4), (2, 3, 9)], "g int, o int, c int")
    kept = {(r["g"], r["o"]) for r in within_budget(rows, "g", "o", "c", 10).collect()}
    assert kept == {(1, 1), (2, 1), (2, 2)}


def test_upsert_and_promotion(spark):
    schema = "src_symbol_id long, dst_symbol_id long, kind string, confidence double, provenance string"
    edges = spark.createDataFrame([(1, 2, "calls", 0.35, "index"), (1, 2, "calls", 0.35, "lsp"), (1, 3, "calls", 0.5, "index"), (4, 5, "calls", 0.6, "index"), (4, 6, "extends", 0.6, None)], schema)
    up = upsert_edges(edges)
    assert up.count() == 4
    assert up.where("dst_symbol_id = 2").first()["provenance"] == "lsp"
    sites = spark.createDataFrame([(4, 5, 1, 10, 2), (1, 3, 1, 3, 4), (7, 7, 1, 1, 1)], "src_symbol_id long, dst_symbol_id long, file_id long, line int, col int")
    facts = spark.createDataFrame([(1, 10, 2, 9), (1, 3, 4, 3), (1, 1, 1, 8), (1, 2, 2, 5), (1, 10, 2, None)], "file_id long, line int, col int, target long")
    out = {tuple(r) for r in promote_edges(up, sites, facts).collect()}
    assert (4, 9, "calls", 1.0, "lsp") in out and (1, 3, "calls", 1.0, "lsp") in out and (4, 6, "extends", 0.6, None) in out
    assert (1, 2, "calls", 0.35, "lsp") in out and len(out) == 4
    # an edge without a fact stays, whatever is known of its source's other calls
    assert {tuple(r) for r in promote_edges(up, sites, facts.where("line = 3")).collect()} >= {(4, 5, "calls", 0.6, "index"), (1, 3, "calls", 1.0, "lsp")}


def test_rank_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, symbol_id long, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, symbol_id long, rank int")
    out = {r["symbol_id"]: (r["rank"], r["score"]) for r in fuse(a, b, 5).collect()}
    assert out[2] == (1, round(1 / 62 + 1 / 61, 9)) and out[1][0] == 2 and out[3][0] == 3


def test_phrases(spark):
    from cairn.operators.retrieval import phrase_matches

    symbols = spark.createDataFrame([(1, "UserService.findAll"), (2, "user.service.find"), (3, "a.user.service.finder.x"), (4, None), (5, "service.user")], "symbol_id long, qualified_name string")
    queries = spark.createDataFrame([("q1", ["user", "service", "fi"]), ("q2", ["userservice", "f"]), ("q3", ["service"]), ("q4", []), ("q5", None), ("q6", ["nobody", "x"]), ("q7", ["service", "user"])], "query_id string, phrase array<string>")
    assert {tuple(r) for r in phrase_matches(symbols, queries, "qualified_name").collect()} == {("q1", 2), ("q1", 3), ("q2", 1), ("q7", 5)}

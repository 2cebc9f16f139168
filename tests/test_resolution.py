"""Import, name and base resolution on a small index written to a folder."""

import pytest

from cairn.operators import relational, resolution
from cairn.operators.relational import Index

FILES = [
    (1, "r/src/a.ts", "typescript"), (2, "r/src/b.ts", "typescript"), (3, "r/src/lib/index.ts", "typescript"), (4, "r/pkg/m.py", "python"), (5, "r/pkg/sub/__init__.py", "python"),
    (6, "r/j/src/org/x/Y.java", "java"), (7, "r/j/A.java", "java"), (8, "r/c/u.hpp", "cpp"), (9, "r/c/m.cpp", "cpp"), (10, "r/lib/z.rb", "ruby"), (11, "r/q.rb", "ruby"), (12, "r/src/n.rs", "rust"), (13, "r/src/k/o.rs", "rust"), (14, "r/g/s.gd", "gdscript"),
]
IMPORTS = [
    (1, 1, "./b.js", ["helper", "Base"], 2), (2, 1, "./lib", ["*"], 3), (3, 1, "outside", ["x"], None), (4, 4, ".sub", [], 5), (5, 4, "pkg.sub", [], 5), (6, 7, "org.x.Y", ["Y"], 6), (7, 9, "u.hpp", None, 8), (8, 9, "<map>", None, None),
    (9, 11, "z", None, 10), (10, 13, "super::n", None, 12), (11, 14, "res://g/s.gd", None, 14), (12, 1, None, None, None), (1, 1, "./b.js", ["helper", "Base"], 2),
]
SYMBOLS = [
    (1, 2, "helper", "function", True, None), (2, 2, "Base", "class", True, None), (3, 1, "own", "function", False, None), (4, 1, "Child", "class", True, [("Base", "extends"), ("ns.Far", "implements"), ("Child", "extends")]),
    (5, 3, "deep", "function", True, None), (6, 4, "Far", "interface", True, None), (7, 4, "many", "function", True, None), (8, 5, "many", "variable", True, None), (9, 4, "map", "function", True, None), (10, 4, "len", "function", True, None), (11, 1, "own", "variable", False, None),
]
OCCURRENCES = [
    (1, 1, "helper", "call"), (2, 1, "own", "call"), (3, 1, "own", "ref"), (4, 1, "deep", "call"), (5, 1, "many", "call"), (6, 1, "many", "ref"), (7, 1, "map", "call"), (8, 5, "len", "call"), (9, 1, "nothing", "ref"), (10, 1, None, "ref"), (10, 1, None, "ref"),
]


@pytest.fixture(scope="module")
def ix(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("index")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("files", [(i, p, lang, 1, False) for i, p, lang in FILES], "file_id long, path string, lang string, indexed_at long, is_test boolean")
    put("imports", [(i, f, s, n, 1, r) for i, f, s, n, r in IMPORTS], "import_id long, file_id long, specifier string, names array<string>, start_line int, resolved_file_id long")
    put("symbols", [(i, f, n, n, k, e, b) for i, f, n, k, e, b in SYMBOLS], "symbol_id long, file_id long, name string, qualified_name string, kind string, is_exported boolean, bases array<struct<name:string,kind:string>>")
    put("occurrences", OCCURRENCES, "occ_id long, file_id long, name string, role string")
    return Index(spark, str(d))


def test_imports_lead_to_files(ix):
    got = {r["import_id"]: r["target_file_id"] for r in resolution.resolve_imports(ix).collect()}
    assert got == {1: 2, 2: 3, 4: 5, 5: 5, 6: 6, 7: 8, 9: 10, 10: 12, 11: 14}


def test_names_by_tier(ix):
    got = {(r["file_id"], r["name"], r["is_call"]): (r["symbol_id"], r["confidence"], r["tier"]) for r in resolution.resolve_names(ix).collect()}
    assert got == {
        (1, "helper", True): (1, 0.9, 1), (1, "own", True): (3, 0.85, 2), (1, "own", False): (3, 0.7, 2), (1, "deep", True): (5, 0.7, 3),
        (1, "many", True): (7, 0.6, 4), (1, "many", False): (7, 0.35, 4),
    }  # map and len are too common in their languages
    assert {r["occ_id"] for r in resolution.resolve_occurrences(ix).collect()} == {1, 2, 3, 4, 5, 6}


def test_bases(ix):
    got = {(r["symbol_id"], r["base_name"]): (r["base_symbol_id"], r["confidence"], r["base_kind"]) for r in resolution.resolve_bases(ix).collect()}
    assert got == {(4, "Base"): (2, 0.9, "extends"), (4, "ns.Far"): (6, 0.7, "implements")}
    assert {(r["src_symbol_id"], r["dst_symbol_id"], r["kind"]) for r in resolution.type_edges(ix).collect()} == {(4, 2, "extends"), (4, 6, "implements")}


def test_pairs_and_counts(ix):
    assert {(r["file_id"], r["resolved_file_id"]) for r in relational.import_pairs(ix).collect()} >= {(1, 2), (1, 3), (4, 5)}
    counts = {r["lang"]: (r["n_files"], r["n_symbols"]) for r in relational.counts_by_language(ix).collect()}
    assert counts["typescript"] == (3, 6) and counts["gdscript"] == (1, 0)


def test_imports_of_go_c_sharp_cpp_and_rust(spark, tmp_path):
    files = [(1, "r/cmd/m.go", "go"), (2, "r/pkg/b.go", "go"), (3, "r/pkg/a.go", "go"), (4, "r/src/t.go", "go"), (5, "r/M.cs", "c_sharp"), (6, "r/z/B.cs", "c_sharp"), (7, "r/z/A.cs", "c_sharp"), (8, "r/c/m.cpp", "cpp"), (9, "r/inc/u.hpp", "cpp"), (10, "r/src/k/o.rs", "rust"), (11, "r/src/a/b.rs", "rust"), (12, "r/top.rs", "rust"), (13, "r/src/x.rs", "rust")]
    imports = [(1, 1, "r/pkg", 3), (2, 1, "src/t", 4), (3, 1, "fmt", None), (4, 5, "static N.S", 7), (5, 8, "lib/u.hpp", 9), (6, 10, "crate::a::b::Type", 11), (7, 10, "crate::top::f", 12), (8, 10, "./x", 13), (9, 1, "pkg/", None), (10, 5, "X = N.S", 7)]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("files", [(i, p, lang, 1, False) for i, p, lang in files], "file_id long, path string, lang string, indexed_at long, is_test boolean")
    put("imports", [(i, f, s, None, 1, None) for i, f, s, _ in imports], "import_id long, file_id long, specifier string, names array<string>, start_line int, resolved_file_id long")
    put("symbols", [(1, 6, "N.S", "N.S", "namespace", True, None), (2, 7, "N.S", "N.S", "namespace", True, None)], "symbol_id long, file_id long, name string, qualified_name string, kind string, is_exported boolean, bases array<struct<name:string,kind:string>>")
    got = {r["import_id"]: r["target_file_id"] for r in resolution.resolve_imports(Index(spark, str(tmp_path))).collect()}
    assert got == {i: t for i, _, _, t in imports if t}

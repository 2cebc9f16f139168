import pytest

from cairn.llm import docpairs as dp


@pytest.mark.parametrize(
    "doc, name, signature, says",
    [
        ("Loads the palette.", "loadPalette", None, False), ("This function indexs import with limit", "index_import_with_limit", None, False), ("The encodeProfile function.", "encodeProfile", None, False),
        ("TODO: measure this again.", "x", None, False), ("@returns", "x", None, False), ("@param key\n:return:", "x", "x(key)", False), ("eslint-disable-next-line no-unused-vars", "x", None, False), ("--- helpers ---", "x", None, False),
        ("Copyright 2026 the maintainers.\nAll rights reserved.", "x", None, False), ("{@inheritDoc}", "x", None, False), ("unwindOld(key, 9)", "x", None, False), ("Same as above.", "x", None, False), ("n/a", "x", None, False), ("", "x", None, False), (None, "x", None, False), ("   \n ", "x", None, False),
        ("Never throws.", "x", None, True), ("Load palette. Blocks until drained.", "loadPalette", None, True), ("@returns compares two lists without looking at whitespace", "x", None, True), ("Compara dos listas sin mirar los espacios.", "x", None, True),
        ("Entfernt den Eintrag sobald niemand mehr darauf verweist.", "x", None, True), ("TODO: later.\nLines count from one here.", "x", None, True), ("@param key both ends must already be indexed", "x", "x(key)", True),
    ],
)
def test_what_says_something(doc, name, signature, says):
    assert dp.informative(doc, name, signature) is says


def spans(lang, text):
    return [(a, b) for a, b, _, _ in sorted(dp.functions(lang, text))]


def test_braces_in_strings_and_comments():
    js = "// Adds {.\nexport function add(a, b) {\n  const r = /[{]+\\}?/.test('}');\n  /* } */\n  return `${a}}`;\n}\n\nconst f = (x) => {\n  return x;\n};\nclass A {\n  // Does it.\n  run(y) {\n    if (y) { y(); }\n  }\n}\n"
    out = sorted(dp.functions("javascript", js))
    assert [(a, b) for a, b, *_ in out] == [(2, 6), (8, 10), (13, 15)]
    assert out[0][3] == "// Adds {." and out[1][3] is None and out[2][3] == "// Does it."


def test_other_families():
    py = 'def a(x,\n      y=1):\n    """Says so.\n    More."""\n    return x\n\n\nclass B:\n    async def c(self):\n        pass\n'
    out = sorted(dp.functions("python", py))
    assert [(a, b) for a, b, *_ in out] == [(1, 5), (9, 10)] and out[0][3].startswith('"""Says so.')
    assert spans("ruby", "# Doc.\ndef a(x)\n  x.each do |i|\n    next if i.nil?\n  end\n  if x\n    1\n  end\nend\n") == [(2, 9)]
    assert spans("c_sharp", "class A\n{\n    public int B(int c)\n    {\n        foreach (var d in c)\n        {\n        }\n        return 1;\n    }\n}\n") == [(3, 9)]
    assert spans("go", "package a\n\nimport (\n\t\"fmt\"\n)\n\nfunc B(c int) (any, error) {\n\tdefer func() {\n\t}()\n\treturn c, nil\n}\n")[0] == (7, 11)
    assert spans("rust", "fn a(s: &str) -> Option<String> {\n    let c = '{';\n    match s {\n        _ => {}\n    }\n    None\n}\n") == [(1, 7)]
    assert spans("javascript", "") == [] and spans("python", "\ufeffdef a():\r\n    pass\r\n") == [(1, 2)]


def test_pairs_table(spark):
    symbols = spark.createDataFrame(
        [(1, 1, "a", "function", 2, 3, "a(x)", "Never throws.", "z"), (1, 1, "a", "function", 2, 3, "a(x)", "Never throws.", "z"), (2, 1, "b", "class", 1, 1, None, "A real text here.", "z"), (3, 2, "c", "method", 1, 1, None, "Blocks until drained.", "z"), (4, 1, None, "function", None, None, None, None, "z"), (5, 1, "odd", "function", 3, 3, None, "Lines count from one here.", "z"), (6, 1, "far", "function", None, None, None, "Never throws.", "z")],
        "symbol_id long, file_id long, name string, kind string, start_line int, end_line int, signature string, doc_comment string, code string",
    )
    files = spark.createDataFrame([(1, "r/a.py", "python"), (2, "r/b.py", "python")], "file_id long, path string, lang string")
    sources = spark.createDataFrame([("r/a.py", "# TODO: later.\ndef a(x):\n    return x\n"), ("r/b.py", None)], "path string, content string")
    rows = {r["symbol_id"]: r for r in dp.doc_pairs(symbols, files, sources).collect()}
    # nothing is said at 1, and 5 and 6 are no functions of the text
    assert set(rows) == {3} and rows[3]["code"] is None and rows[3]["readable"] is False
    sources = spark.createDataFrame([("r/a.py", "# Never throws.\ndef a(x):\n    return x\n"), ("r/b.py", None)], "path string, content string")
    rows = {r["symbol_id"]: r for r in dp.doc_pairs(symbols, files, sources).collect()}
    assert set(rows) == {1, 3} and rows[1]["code"] == "def a(x):\n    return x" and rows[1]["comment"] == "# Never throws." and rows[1]["readable"]
    assert dp.doc_pairs(symbols.limit(0), files, sources).count() == 0
    clash = files.selectExpr("*", "1 AS p", "2 AS fid", "3 AS lid", "'x' AS content", "'y' AS code")
    assert {r["symbol_id"] for r in dp.doc_pairs(symbols.selectExpr("*", "1 AS fid", "'z' AS comment"), clash, sources.selectExpr("*", "1 AS file_id", "'go' AS lang")).collect()} == {1, 3}


@pytest.mark.parametrize(
    "comment, text",
    [('"""Says so.\n    More."""', "Says so.\n    More."), ("/** Never throws.\n * @param x\n */", " Never throws."), ("// One.\n// Two.", "One.\nTwo."), ("/// <summary>A.</summary>", "<summary>A.</summary>"), ("=begin\nA.\n=end", "\nA.\n"), (None, None)],
)
def test_marks(comment, text):
    assert (dp.without_marks(comment) or "").strip().startswith((text or "").strip().split("\n")[0])


def test_both_wordings_are_asked_where_they_differ():
    assert dp.documented("// Never throws.", "Never throws.", "x", None) and not dp.documented("// Never throws.", "TODO", "x", None)
    assert not dp.documented("// TODO: later", "Never throws.", "x", None) and not dp.documented(None, "Never throws.", "x", None)

from cairn.operators.orphans import orphan_cascade, orphan_counts

DAY = 86_400_000
T0 = 1_772_323_200_000  # 2026-03-01


def tables(spark, **rows):
    schemas = {
        "files": "file_id long, path string, lang string, indexed_at long, is_test boolean, day string",
        "symbols": "symbol_id long, file_id long, parent_symbol_id long, reason string",
        "imports": "import_id long, file_id long, specifier string, resolved_file_id long",
        "occurrences": "occ_id long, file_id long, resolved_symbol_id long",
        "edges": "src_symbol_id long, dst_symbol_id long, kind string, level int",
        "assets": "asset_id long, path string, indexed_at long",
        "asset_refs": "ref_id long, asset_id long, target_kind string, target string",
        "removals": "rec_table string, rec_id long",
    }
    return {k: spark.createDataFrame(rows.get(k, []), s) for k, s in schemas.items()}


def test_reasons_periods_and_inheritance(spark):
    t = tables(
        spark,
        files=[(1, "r/a/x.ts", "typescript", T0, False, "z"), (1, "r/a/x.ts", "typescript", T0 + 5 * DAY, False, "z"), (2, "r/a/y.ts", "typescript", T0 + DAY, False, None), (3, "r/s.gd", "gdscript", T0 + 3 * DAY, None, None)],
        symbols=[(10, 1, None, None), (11, 2, 99, None), (12, 2, 11, None), (12, 2, 11, None), (13, 7, None, None)],
        imports=[(1, 1, "./y", None), (2, 1, "./y.js", None), (3, 1, "../b", None), (4, 1, "pkg", None), (5, 1, None, 2), (6, 1, "./q", 50), (7, 1, "./q", 51), (8, 8, "./q", None)],
        occurrences=[(1, 1, 10), (2, 1, 11), (3, 1, 77), (3, 1, 77), (4, 1, 78), (5, 1, None), (6, None, 77), (7, 2, 12)],
        assets=[(1, "r/m.tscn", T0)],
        asset_refs=[(1, 1, "script", "res://s.gd"), (2, 1, "script", "res://none.gd"), (3, 1, "scene", "res://m.tscn"), (4, 1, "prefab", "ab" * 16), (5, 1, "guid_of", "cd" * 16), (6, 1, "asset", "cd" * 16), (7, 1, "asset", "0" * 16 + "f" * 16), (8, 1, "plugin", "Name"), (9, 1, "script", None)],
        removals=[("symbols", 78), ("files", 51), ("symbols", 10)],
    )
    out = orphan_cascade(t)
    rows = {(r["src_table"], r["field_name"], r["row_id"], r["reason"], r["period_day"], r["level"]) for r in out.collect()}
    day = "2026-03-01"
    direct = {x for x in rows if x[5] == 0 and x[0] != "symbols" and x[1] != "file_id"}
    assert ("imports", "file_id", 8, "missing", None, 0) in rows
    assert direct == {
        ("occurrences", "resolved_symbol_id", 2, "late", day, 0), ("occurrences", "resolved_symbol_id", 3, "missing", day, 0), ("occurrences", "resolved_symbol_id", 4, "deleted", day, 0),
        ("occurrences", "resolved_symbol_id", 6, "missing", None, 0), ("imports", "specifier", 3, "missing", day, 0), ("imports", "resolved_file_id", 5, "late", day, 0),
        ("imports", "resolved_file_id", 6, "missing", day, 0), ("imports", "resolved_file_id", 7, "deleted", day, 0),
        ("asset_refs", "target", 1, "late", day, 0), ("asset_refs", "target", 2, "missing", day, 0), ("asset_refs", "target", 4, "missing", day, 0),
    }
    assert ("symbols", "parent_symbol_id", 11, "missing", "2026-03-02", 0) in rows
    assert ("symbols", "parent_symbol_id", 12, "missing", "2026-03-02", 1) in rows
    assert ("symbols", "file_id", 13, "missing", None, 0) in rows
    assert ("occurrences", "resolved_symbol_id", 7, "missing", "2026-03-02", 2) in rows
    counts = {(r["src_table"], r["reason"]): (r["n_direct"], r["n_inherited"]) for r in orphan_counts(out).where("period_day = '2026-03-02'").collect()}
    assert counts[("symbols", "missing")] == (1, 1)


def test_empty_tables(spark):
    assert orphan_cascade(tables(spark)).count() == 0


def test_a_long_chain_with_a_circle_beside_it_and_edges(spark):
    n = 2000
    chain = [(i, 1, i - 1 if i > 1 else 9_999_999, None) for i in range(1, n + 1)]
    circle = [(n + 1, 1, n + 2, None), (n + 2, 1, n + 1, None), (n + 3, 1, n + 2, None), (n + 4, 77, 5, None)]
    t = tables(
        spark,
        files=[(1, "r/a.py", "python", T0, False, None)],
        symbols=chain + circle,
        edges=[(1, 5, "calls", 3), (1, 5, "calls", 4), (n + 1, 12_345, "calls", None), (n + 1, n + 2, None, None), (None, None, None, None)],
        removals=[("files", 77)],
    )
    rows = orphan_cascade(t).collect()
    levels = {r["row_id"]: r["level"] for r in rows if r["src_table"] == "symbols" and r["field_name"] == "parent_symbol_id"}
    assert levels == {i: i - 1 for i in range(1, n + 1)}
    assert [(r["row_id"], r["reason"], r["level"]) for r in rows if r["field_name"] == "file_id"] == [(n + 4, "deleted", 0)]
    edges = {(r["field_name"], r["row_key"], r["reason"], r["level"]) for r in rows if r["src_table"] == "edges"}
    assert edges == {("src_symbol_id", "1>5:calls", "missing", 1), ("dst_symbol_id", "1>5:calls", "missing", 5), ("dst_symbol_id", f"{n + 1}>12345:calls", "missing", 0)}
    assert len(rows) == n + 1 + 3

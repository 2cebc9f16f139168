from test_lookups import fixture

from cairn.operators import maintenance as m
from cairn.sources import manifests, scenes, workspace


def test_replacing_files_and_assets(spark):
    ix = fixture(spark)
    scope = ix.files.where("file_id = 2").select("file_id")
    fresh = {"files": ix.files.where("file_id = 2"), "symbols": ix.symbols.where("symbol_id = 20")}
    out = m.replace_files(ix, scope, fresh)
    assert sorted(r["symbol_id"] for r in out["symbols"].collect()) == [10, 20] and out["files"].count() == 2 and out["edges"].count() == 0
    assets = spark.createDataFrame([(1, "a"), (2, "b")], "asset_id long, path string")
    refs = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "ref_id long, asset_id long")
    a, b = m.replace_assets(assets, refs, assets.where("asset_id = 2"), assets.where("asset_id = 2"), refs.limit(0))
    assert a.count() == 2 and {r["ref_id"] for r in b.collect()} == {1, 3}


def test_vectors(spark):
    schema = "chunk_id long, embedding array<float>, model string, seq long"
    old = spark.createDataFrame([(1, [1.0], "a", 1), (2, [2.0], "a", 1), (3, [3.0], "b", 1), (None, [1.0], "a", 1)], schema)
    new = spark.createDataFrame([(1, [9.0], "a", 2), (1, [9.0], "a", 2), (4, None, "a", 2)], schema)
    assert {(r["chunk_id"], r["embedding"] and r["embedding"][0]) for r in m.upsert_vectors(old, new, "a").collect()} == {(1, 9.0), (2, 2.0), (4, None)}
    assert m.upsert_vectors(old, new, "c").count() == 0


def test_changes_and_what_they_break(spark):
    schema = "file_id long, name string, kind string, signature string, symbol_id long"
    old = spark.createDataFrame([(1, "f", "function", "f(a)", 1), (1, "g", "function", None, 2), (1, "h", None, "h()", 3), (1, None, "function", "x", 4), (2, "h", None, "h()", 5)], schema)
    new = spark.createDataFrame([(1, "f", "function", "f(a, b)", 1), (1, "k", "function", "k()", 6), (1, "f", "function", "f(a, b)", 1), (2, "h", None, "h()", 5)], schema)
    changes = m.symbol_changes(old, new)
    assert {(r["file_id"], r["name"], r["change"]) for r in changes.collect()} == {(1, "f", "changed"), (1, "g", "removed"), (1, "h", "removed"), (1, "k", "added")}
    occ = spark.createDataFrame([(1, 2, "g", 2), (2, 2, "g", None), (3, 1, "g", None), (4, 2, "h", None), (5, 2, "h", 3), (6, 2, None, None)], "occ_id long, file_id long, name string, resolved_symbol_id long")
    # h is still declared in file 2, so only the use resolved to the removed one is broken
    assert {r["occ_id"] for r in m.broken_references(changes, occ, old).collect()} == {1, 2, 5}
    assert m.symbol_changes(old.limit(0), new.limit(0)).count() == 0


def test_manifests(spark):
    texts = spark.createDataFrame(
        [
            ("r/go.mod", "// x\nmodule example.invalid/kit/v2\n\ngo 1.22\n"), ("r/app/pubspec.yaml", "name: app_one\nversion: 1\n"), ("r/composer.json", '{"autoload": {"psr-4": {"App\\\\": "src/", "App\\\\Deep\\\\": "deep"}}, "autoload-dev": {"psr-4": {"T\\\\": "tests/"}}}'),
            ("r/package.json", '{"main": "./lib/a.js", "bin": {"x": "bin/x.js"}, "types": "lib/a.d.ts"}'), ("s/package.json", '{"bin": "run.js"}'), ("t/package.json", "no json"), ("u/go.mod", None),
        ],
        "path string, content string",
    )
    assert [tuple(r) for r in manifests.go_modules(texts).collect()] == [("r", "example.invalid/kit/v2")]
    assert [tuple(r) for r in manifests.dart_packages(texts).collect()] == [("r/app", "app_one")]
    assert [tuple(r) for r in manifests.composer_roots(texts).collect()] == [("r", "App\\Deep\\", "r/deep"), ("r", "App\\", "r/src"), ("r", "T\\", "r/tests")]
    assert {tuple(r) for r in manifests.package_entries(texts).collect()} == {("r", "r/lib/a.js"), ("r", "r/bin/x.js"), ("r", "r/lib/a.d.ts"), ("s", "s/run.js")}


def test_engine_files(spark):
    project = '[application]\nconfig/name="x"\n[autoload]\nScores="*res://scores.gd"\nPlain="res://plain.gd"\n[input]\na="b"\n'
    scene = '[node name="Root" type="Node"]\n[connection signal="pressed" from="A/B" to="." method="_on_pressed"]\n'
    unity = "--- !u!1 &100\nGameObject:\n  m_Name: Hero One\n--- !u!114 &200\nMonoBehaviour:\n  m_GameObject: {fileID: 100}\n  m_Script: {fileID: 1, guid: " + "AB" * 16 + ", type: 3}\n"
    build = 'PublicDependencyModuleNames.AddRange(new string[] { "Core", "Engine" });\nPrivateDependencyModuleNames.Add("Slate");\n'
    texts = spark.createDataFrame([("r/project.godot", project), ("r/a.tscn", scene), ("r/h.prefab", unity), ("r/X.Build.cs", build), ("r/n.Build.cs", None)], "path string, content string")
    assert {(r["name"], r["target"], r["is_singleton"]) for r in scenes.godot_autoloads(texts).collect()} == {("Scores", "res://scores.gd", True), ("Plain", "res://plain.gd", False)}
    assert [tuple(r)[1:] for r in scenes.godot_connections(texts).collect()] == [("pressed", "A/B", ".", "_on_pressed")]
    assert [tuple(r)[1:] for r in scenes.unity_scripts(texts).collect()] == [("Hero One", "script", "ab" * 16)]
    assert {tuple(r)[1:] for r in scenes.unreal_dependencies(texts).collect()} == {("Core", "public"), ("Engine", "public"), ("Slate", "private")}
    nodes = spark.createDataFrame([("s", "Root", None), ("s", "A", "."), ("s", "B", "A")], "path string, node string, parent string")
    assert [r["node_path"] for r in scenes.godot_node_paths(nodes).collect()] == [".", "A", "A/B"]


def test_scan_reports_what_it_leaves_out(spark, tmp_path):
    for name, text in (("a.py", "x = 1\n"), ("big.py", "x" * 5000), ("node_modules/m.js", "f()"), ("notes.txt", "hello"), ("b.hxx", "int a;")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["path"] for r in workspace.scan(spark, str(tmp_path)).collect()} == {"a.py", "big.py", "b.hxx"}
    assert {r["path"] for r in workspace.scan(spark, str(tmp_path), max_bytes=1000).collect()} == {"a.py", "b.hxx"}
    assert {r["path"]: r["why"] for r in workspace.left_out(spark, str(tmp_path), "b[.]", 1000).collect()} == {"big.py": "large", "node_modules/m.js": "ignored", "notes.txt": "unknown", "b.hxx": "ignored"}

from pyspark.sql import functions as F

from cairn.sources import history, scenes, workspace


def test_scan(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "src/B.TS": "let a\n", "node_modules/x.js": "1", "notes.txt": "n", "s/level.tscn": "[node]", "project.godot": "[application]", "empty.py": "", "X.Build.cs": "a"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["path"]: r for r in workspace.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.py", "src/B.TS", "s/level.tscn", "project.godot", "X.Build.cs"}
    assert rows["src/B.TS"]["lang"] == "typescript" and rows["s/level.tscn"]["asset"]["engine"] == "godot" and rows["X.Build.cs"]["asset"]["kind"] == "build"
    assert rows["src/a.py"]["content"] == "x = 1\n" and rows["src/a.py"]["size"] == 6
    assert set(r["path"] for r in workspace.scan(spark, str(tmp_path), r"^src/").collect()) == set(rows) - {"src/a.py", "src/B.TS"}


def test_history(spark):
    text = "+++ b/a/x.ts\n@@ -1,2 +12,5 @@ f\n+a\n@@ -9 +30 @@\n@@ -1,1 +45,0 @@\n+++ b/y.ts\n@@ -0,0 +1,3 @@\nnot @@ a hunk"
    out = {tuple(r) for r in history.hunks(spark.createDataFrame([(1, text), (2, None)], "diff_id int, text string")).collect()}
    assert out == {(1, "a/x.ts", 12, 5), (1, "a/x.ts", 30, 1), (1, "a/x.ts", 45, 0), (1, "y.ts", 1, 3)}
    lines = [("3\t1\tsrc/{old => new}/u.ts",), ("2\t0\tsrc/new/u.ts",), ("-\t-\tb.png",), ("1\t1\told.ts => new.ts",), ("commit abc",), (None,)]
    churn = {r["path"]: (r["commits"], r["added"], r["deleted"]) for r in history.churn(spark.createDataFrame(lines, "line string")).collect()}
    assert churn == {"src/new/u.ts": (2, 5, 1), "b.png": (1, 0, 0), "new.ts": (1, 1, 1)}
    symbols = spark.createDataFrame([(1, 7, 1, 10), (2, 7, 11, 20), (3, 8, 1, 99)], "symbol_id long, file_id long, start_line int, end_line int")
    changes = spark.createDataFrame([(7, 10, 0), (7, 15, 2)], "file_id long, start int, count int")
    assert {r[0] for r in history.touched_symbols(symbols, changes).collect()} == {1, 2}


def test_scenes(spark):
    text = '[gd_scene]\n[ext_resource type="Script" path="res://p.gd" id="1_a"]\n[ext_resource path="res://e.tscn" type="PackedScene" id=2]\n[node name="Player" type="Body"]\nscript = ExtResource("1_a")\n[node name="Enemy" parent="." instance=ExtResource( 2 )]\n'
    rows = {r["node"]: r for r in scenes.godot_nodes(spark.createDataFrame([("l.tscn", text), ("n.tscn", None)], "path string, content string")).collect()}
    assert rows["Player"]["script_path"] == "res://p.gd" and rows["Player"]["type"] == "Body" and rows["Enemy"]["instance_path"] == "res://e.tscn" and rows["Enemy"]["parent"] == "."
    g = "ab" * 16
    found = {(r["path"], r["guid"], r["is_own"]) for r in scenes.unity_guids(spark.createDataFrame([("a.cs.meta", f"guid: {g}"), ("m.prefab", f"{{fileID: 1, guid: {g.upper()}, type: 3}}")], "path string, content string")).collect()}
    assert found == {("a.cs.meta", g, True), ("m.prefab", g, False)}
    project = '{"Modules": [{"Name": "Game", "Type": "Runtime"}], "Plugins": [{"Name": "In", "Enabled": true}, {"Name": "Out", "Enabled": false}]}'
    assert {(r["name"], r["detail"]) for r in scenes.unreal_modules(spark.createDataFrame([("g.uproject", project), ("b.uproject", "no json")], "path string, content string")).collect()} == {("Game", "Runtime"), ("In", "plugin")}
    assert scenes.godot_nodes(spark.createDataFrame([], "path string, content string")).count() == 0
    assert spark.range(1).select(workspace.language(F.lit("a/b.unknown")).alias("l")).first()["l"] is None

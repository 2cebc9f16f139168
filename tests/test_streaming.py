import datetime as dt

from cairn.streaming import changes as c


def at(s):
    return dt.datetime(2026, 3, 1, 0, 0, s)


def test_incremental_equals_full(spark, tmp_path):
    batches = [
        [("a.py", "add", "x", at(1)), ("b.py", "add", "y", at(1)), ("a.py", "change", "x2", at(2))],
        [("b.py", "unlink", None, at(3)), ("c.py", "add", "z", at(3)), ("a.py", "change", "x2", at(4))],
        [("d.py", "add", "d", at(5)), ("d.py", "unlink", None, at(6)), (None, "add", "n", at(6))],
    ]
    snapshots = c.Snapshots(spark, str(tmp_path / "files"))
    for rows in batches:
        spark.createDataFrame(rows, c.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(c.SCHEMA).parquet(str(tmp_path / "in"))
        c.maintain(stream, snapshots, str(tmp_path / "ck")).awaitTermination()
    got = {(r["path"], r["size"]) for r in snapshots.current().collect()}
    whole = c.apply_changes(spark.createDataFrame([], c.FILES), spark.createDataFrame([r for b in batches for r in b], c.SCHEMA))
    assert got == {("a.py", 2), ("c.py", 1)} == {(r["path"], r["size"]) for r in whole.collect()}
    # content that was indexed before kept its row
    assert snapshots.current().where("path = 'a.py'").first()["changed_at"] == at(2)


def test_debounce(spark):
    rows = [("a", "change", "", at(1)), ("a", "change", "", at(2)), ("a", "change", "", at(9)), ("b", "add", "", at(1))]
    out = {(r["path"], r["n"]) for r in c.debounced(spark.createDataFrame(rows, c.SCHEMA), "3 seconds").collect()}
    assert out == {("a", 2), ("a", 1), ("b", 1)}


def extract(files):
    """A line ``def x`` is a function of that line and the next, ``use x`` on the next a call, ``import p`` an import."""
    from pyspark.sql import functions as F

    lines = files.select("file_id", "path", F.posexplode(F.split("content", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    word = F.regexp_extract("line", r"^\w+ (.+)$", 1)
    key = lambda *c: F.xxhash64("path", *c)
    symbols = lines.where("startswith(line, 'def ')").select(
        key(F.lit("s"), "n").alias("symbol_id"), "file_id", word.alias("name"), F.lit("function").alias("kind"), F.col("n").alias("start_line"), F.lit(0).alias("start_col"), (F.col("n") + 1).alias("end_line"), F.lit(99).alias("end_col"), F.lit(True).alias("is_exported")
    )
    calls = lines.where("startswith(line, 'use ')").select(
        key(F.lit("o"), "n").alias("occ_id"), "file_id", word.alias("name"), F.lit("call").alias("role"), F.col("n").alias("start_line"), F.lit(4).alias("start_col"), F.lit(None).cast("long").alias("resolved_symbol_id"), F.lit(None).cast("double").alias("confidence")
    )
    imports = lines.where("startswith(line, 'import ')").select(key(F.lit("i"), "n").alias("import_id"), "file_id", word.alias("specifier"), F.xxhash64(word).alias("resolved_file_id"))
    return {"symbols": symbols, "imports": imports, "occurrences": calls}


def test_index_follows_changes(spark, tmp_path):
    from cairn.streaming import index as ix

    batches = [
        [("a", "add", "def f\nuse g", at(1)), ("b", "add", "import a\ndef g\nuse f", at(1)), ("c", "add", "def h\nuse k", at(1))],
        [("a", "change", "def k\nuse g\ndef f\nuse f", at(2)), ("c", "change", "def h\nuse k", at(3))],
        [("b", "unlink", None, at(4)), ("d", "add", "def m\nuse k", at(4)), (None, "add", "def z", at(4)), ("e", "add", None, at(4))],
    ]
    snapshots = ix.IndexSnapshots(spark, str(tmp_path / "index"))
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, c.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(c.SCHEMA).parquet(str(tmp_path / "in"))
        ix.maintain_index(stream, snapshots, extract, str(tmp_path / "ck")).awaitTermination()
        tables = snapshots.current()
        names = {r["symbol_id"]: r["name"] for r in tables["symbols"].collect()}
        seen.append({(names[r["src_symbol_id"]], names[r["dst_symbol_id"]]) for r in tables["edges"].collect()})
    assert seen == [{("f", "g"), ("g", "f")}, {("k", "g"), ("g", "f"), ("h", "k")}, {("h", "k"), ("m", "k")}]
    whole = ix.apply_batch(spark, ix.empty_index(spark), spark.createDataFrame([r for b in batches for r in b], c.SCHEMA), extract)
    for name in ("files", "symbols", "imports", "edges"):
        assert sorted(map(str, whole[name].select(*tables[name].columns).collect())) == sorted(map(str, tables[name].collect()))

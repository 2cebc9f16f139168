"""A tree of source files as a DataFrame: read with Spark's own file sources, kept by language or asset kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import base_name, extension

# Languages by extension.
EXTENSIONS = {
    "typescript": [".ts", ".mts", ".cts"], "tsx": [".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py", ".pyi"], "go": [".go"], "rust": [".rs"], "java": [".java"],
    "c": [".c"], "cpp": [".cpp", ".cc", ".cxx", ".h", ".hpp", ".hh", ".hxx", ".inl"], "c_sharp": [".cs"], "gdscript": [".gd"], "php": [".php"], "ruby": [".rb", ".rake", ".gemspec"], "kotlin": [".kt", ".kts"], "swift": [".swift"],
    "lua": [".lua"], "scala": [".scala", ".sc"], "dart": [".dart"], "solidity": [".sol"], "zig": [".zig"], "nix": [".nix"], "terraform": [".tf", ".tfvars", ".hcl"], "pascal": [".pas", ".pp", ".dpr", ".lpr"], "vue": [".vue"], "svelte": [".svelte"],
}
# Asset kinds by extension, with their engine.
ASSETS = {
    ".tscn": ("scene", "godot"), ".tres": ("resource", "godot"), ".prefab": ("prefab", "unity"), ".unity": ("scene", "unity"), ".asset": ("asset", "unity"), ".meta": ("meta", "unity"),
    ".uproject": ("uproject", "unreal"), ".uplugin": ("uplugin", "unreal"),
}
IGNORED = r"(^|/)(\.git|node_modules|dist|build|target|out|\.venv|venv|__pycache__|\.idea|\.vscode|coverage|\.next|\.nuxt|vendor/bundle)(/|$)"


def language(path: Column) -> Column:
    """The language a path's extension stands for, else null."""
    out = F.lit(None).cast("string")
    for lang, endings in EXTENSIONS.items():
        out = F.when(extension(path).isin(endings), F.lit(lang)).otherwise(out)
    return out


def asset(path: Column) -> Column:
    """struct<kind, engine> of an asset's path, else null."""
    kind = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("engine"))
    out = F.when(F.lit(False), kind)
    for ending, (k, engine) in ASSETS.items():
        out = F.when(extension(path) == ending, F.struct(F.lit(k).alias("kind"), F.lit(engine).alias("engine"))).otherwise(out)
    out = F.when(base_name(path) == "project.godot", F.struct(F.lit("project").alias("kind"), F.lit("godot").alias("engine"))).otherwise(out)
    return F.when(F.lower(base_name(path)).endswith(".build.cs"), F.struct(F.lit("build").alias("kind"), F.lit("unreal").alias("engine"))).otherwise(out)


def listed(spark: SparkSession, root: str, exclude: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """path (below the root), lang, asset, content, size, mtime_ms and why (null, ``ignored``, ``unknown`` or ``large``) of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cut = F.element_at(F.split("path", F.lit(root.rstrip("/") + "/"), 2), -1)
    rows = files.select(cut.alias("path"), "content", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"))
    rows = rows.withColumn("lang", language(F.col("path"))).withColumn("asset", asset(F.col("path")))
    ignored = F.col("path").rlike(IGNORED) | (F.col("path").rlike(exclude) if exclude else F.lit(False))
    large = F.col("size") > max_bytes if max_bytes is not None else F.lit(False)
    why = F.when(ignored, "ignored").when(F.col("lang").isNull() & F.col("asset").isNull(), "unknown").when(large, "large")
    return rows.withColumn("why", why)


def scan(spark: SparkSession, root: str, exclude: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """path, lang, asset, content, hash, size, mtime_ms of the files worth indexing.

    Files that are ignored, larger than ``max_bytes`` (no bound by default), or neither of a known language nor an asset
    are left out before they are read; ``left_out`` tells which. Spark's reader gives no row for empty files.
    """
    text = F.decode("content", "UTF-8")
    kept = listed(spark, root, exclude, max_bytes).where("why is null")
    return kept.select("path", "lang", "asset", text.alias("content"), F.sha1(text).alias("hash"), "size", "mtime_ms")


def left_out(spark: SparkSession, root: str, exclude: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """path, size, why of the files that a scan leaves out; their content isn't read."""
    return listed(spark, root, exclude, max_bytes).where("why is not null").select("path", "size", "why")

"""Manifests of packages as tables: what a folder's modules are called and where they begin. texts: path, content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import base_name, join_path, normalize_path, parent_dir

_STRINGS = "map<string,string>"


def _named(texts: DataFrame, name: str) -> DataFrame:
    return texts.where((base_name(F.col("path")) == name) & F.col("content").isNotNull()).select(parent_dir(F.col("path")).alias("root"), "content")


def go_modules(texts: DataFrame) -> DataFrame:
    """root, module of every go.mod."""
    found = F.nullif(F.regexp_extract("content", r"(?m)^\s*module\s+\"?([^\s\"/][^\s\"]*)", 1), F.lit(""))
    return _named(texts, "go.mod").select("root", found.alias("module")).where("module is not null")


def dart_packages(texts: DataFrame) -> DataFrame:
    """root, module of every pubspec.yaml."""
    found = F.nullif(F.regexp_extract("content", r"(?m)^name:\s*['\"]?([\w.-]+)", 1), F.lit(""))
    return _named(texts, "pubspec.yaml").select("root", found.alias("module")).where("module is not null")


def composer_roots(texts: DataFrame) -> DataFrame:
    """root, prefix, folder of every PSR-4 entry of composer.json, development ones included; place 1 is the longest prefix."""
    part = f"struct<`psr-4`:{_STRINGS}>"
    json = F.from_json("content", f"autoload {part}, `autoload-dev` {part}").alias("j")
    rows = _named(texts, "composer.json").select("root", json)
    both = rows.select("root", F.explode(F.array("j.autoload.`psr-4`", "j.`autoload-dev`.`psr-4`")).alias("m")).where("m is not null")
    rows = both.select("root", F.explode("m").alias("prefix", "dir")).select("root", "prefix", normalize_path(join_path(F.col("root"), F.col("dir"))).alias("folder"))
    return rows.distinct().orderBy(F.desc(F.length("prefix")), "prefix", "folder")


def package_entries(texts: DataFrame) -> DataFrame:
    """root, entry: the files that package.json names as main, module, types or bin."""
    json = F.from_json("content", "main string, module string, types string, browser string").alias("j")
    programs = F.coalesce(F.map_values(F.from_json(F.get_json_object("content", "$.bin"), _STRINGS)), F.array(F.when(~F.get_json_object("content", "$.bin").startswith("{"), F.get_json_object("content", "$.bin"))))
    rows = _named(texts, "package.json").select("root", json, programs.alias("bin"))
    named = F.concat(F.array("j.main", "j.module", "j.types", "j.browser"), F.coalesce("bin", F.array().cast("array<string>")))
    return rows.select("root", F.explode(named).alias("e")).where("e is not null").select("root", normalize_path(join_path(F.col("root"), F.col("e"))).alias("entry")).distinct()

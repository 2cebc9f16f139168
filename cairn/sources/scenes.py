"""Engine assets as tables: Godot scenes, Unity object files and Unreal manifests, line by line in Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lines(texts: DataFrame) -> DataFrame:
    return texts.where("content is not null").select("path", F.posexplode(F.split("content", "\r?\n")).alias("n", "line"))


def godot_nodes(texts: DataFrame) -> DataFrame:
    """path, node, type, parent, script_path, instance_path of the nodes of text scenes (path, content)."""
    lines = _lines(texts)
    attribute = lambda name: F.nullif(F.regexp_extract("line", rf'(?:^|[\[\s]){name}="([^"]*)"', 1), F.lit(""))
    reference = lambda name: F.nullif(F.regexp_extract("line", rf'{name}\s*=\s*ExtResource\(\s*"?([^")\s]+)"?\s*\)', 1), F.lit(""))
    resources = lines.where(F.col("line").startswith("[ext_resource")).select(
        "path", F.coalesce(attribute("id"), F.nullif(F.regexp_extract("line", r"\bid=(\d+)", 1), F.lit(""))).alias("rid"), attribute("path").alias("target")
    )
    section = F.when(F.col("line").startswith("["), F.col("n"))
    marked = lines.withColumn("at", F.last(section, ignorenulls=True).over(Window.partitionBy("path").orderBy("n")))
    nodes = marked.where(F.col("line").startswith("[node")).select("path", "at", attribute("name").alias("node"), attribute("type").alias("type"), attribute("parent").alias("parent"), reference("instance").alias("iid"))
    scripts = marked.select("path", "at", reference("script").alias("sid")).where("sid is not null")
    r1, r2 = resources.withColumnsRenamed({"rid": "sid", "target": "script_path"}), resources.withColumnsRenamed({"rid": "iid", "target": "instance_path"})
    return nodes.join(scripts, ["path", "at"], "left").join(r1, ["path", "sid"], "left").join(r2, ["path", "iid"], "left").select("path", "node", "type", "parent", "script_path", "instance_path")


def unity_guids(texts: DataFrame) -> DataFrame:
    """path, guid, is_own of every guid in object files; the guid of a .meta file is that of the file beside it."""
    found = _lines(texts).select("path", F.explode(F.regexp_extract_all("line", F.lit(r"\bguid:\s*([0-9a-fA-F]{32})"), F.lit(1))).alias("guid"))
    return found.select("path", F.lower("guid").alias("guid"), F.col("path").endswith(".meta").alias("is_own")).distinct()


def unreal_modules(texts: DataFrame) -> DataFrame:
    """path, name, detail of the modules and enabled plugins of project files (JSON)."""
    schema = "Modules array<struct<Name:string,Type:string>>, Plugins array<struct<Name:string,Enabled:boolean>>"
    rows = texts.where("content is not null").select("path", F.from_json("content", schema).alias("j"))
    modules = rows.select("path", F.explode("j.Modules").alias("m")).select("path", F.col("m.Name").alias("name"), F.col("m.Type").alias("detail"))
    plugins = rows.select("path", F.explode("j.Plugins").alias("p")).where("p.Enabled").select("path", F.col("p.Name").alias("name"), F.lit("plugin").alias("detail"))
    return modules.unionByName(plugins)


def godot_autoloads(texts: DataFrame) -> DataFrame:
    """path, name, target, is_singleton of the scripts that project.godot loads by itself."""
    lines = _lines(texts)
    section = F.nullif(F.regexp_extract("line", r"^\[(\w+)\]", 1), F.lit(""))
    marked = lines.withColumn("section", F.last(section, ignorenulls=True).over(Window.partitionBy("path").orderBy("n")))
    found = marked.where("section = 'autoload'").select(
        "path", F.regexp_extract("line", r'^\s*([\w.]+)\s*=\s*"(\*?)([^"]+)"', 1).alias("name"), F.regexp_extract("line", r'^\s*[\w.]+\s*=\s*"\*?([^"]+)"', 1).alias("target"),
        F.col("line").rlike(r'=\s*"\*').alias("is_singleton"),
    )
    return found.where("name <> ''")


def godot_connections(texts: DataFrame) -> DataFrame:
    """path, signal, from_node, to_node, method of the connections of text scenes."""
    attribute = lambda name: F.nullif(F.regexp_extract("line", rf'\b{name}="([^"]*)"', 1), F.lit(""))
    rows = _lines(texts).where(F.col("line").startswith("[connection"))
    return rows.select("path", attribute("signal").alias("signal"), attribute("from").alias("from_node"), attribute("to").alias("to_node"), attribute("method").alias("method")).where("method is not null")


def godot_node_paths(nodes: DataFrame) -> DataFrame:
    """path, node, node_path: a node's way from the scene's root, which is ``.``."""
    way = F.when(F.col("parent").isNull(), F.lit(".")).when(F.col("parent") == ".", F.col("node")).otherwise(F.concat("parent", F.lit("/"), "node"))
    return nodes.select("path", "node", way.alias("node_path"))


def unity_scripts(texts: DataFrame) -> DataFrame:
    """path, object_name, kind, guid of the references of object files, with the name of the object they lie in."""
    lines = _lines(texts)
    by = Window.partitionBy("path").orderBy("n")
    anchor = F.nullif(F.regexp_extract("line", r"^--- !u!\d+ &(-?\d+)", 1), F.lit(""))
    owner = F.nullif(F.regexp_extract("line", r"^\s*m_GameObject:\s*\{fileID:\s*(-?\d+)\}", 1), F.lit(""))
    marked = lines.withColumn("anchor", F.last(anchor, ignorenulls=True).over(by))
    names = marked.select("path", "anchor", F.nullif(F.regexp_extract("line", r"^\s*m_Name:\s*(.+?)\s*$", 1), F.lit("")).alias("name")).where("name is not null and anchor is not null")
    names = names.groupBy("path", F.col("anchor").alias("oid")).agg(F.first("name").alias("object_name"))
    owners = marked.select("path", "anchor", owner.alias("owner")).where("owner is not null").groupBy("path", "anchor").agg(F.first("owner").alias("owner"))
    kind = F.when(F.col("line").contains("m_Script:"), "script").when(F.col("line").rlike(r"m_(SourcePrefab|ParentPrefab|PrefabAsset):"), "prefab").otherwise("asset")
    refs = marked.select("path", "anchor", kind.alias("kind"), F.lower(F.regexp_extract("line", r"\bguid:\s*([0-9a-fA-F]{32})", 1)).alias("guid")).where("guid <> ''")
    refs = refs.join(owners, ["path", "anchor"], "left").withColumn("oid", F.coalesce("owner", "anchor"))
    return refs.join(names, ["path", "oid"], "left").select("path", "object_name", "kind", "guid").distinct()


def unreal_dependencies(texts: DataFrame) -> DataFrame:
    """path, module, visibility of the modules that Build.cs files depend on."""
    rows = texts.where(F.lower("path").endswith(".build.cs") & F.col("content").isNotNull())
    calls = F.regexp_extract_all("content", F.lit(r"((?:Public|Private|DynamicallyLoaded)\w*ModuleNames\s*\.\s*Add(?:Range)?\s*\([^;]*)"), F.lit(1))
    calls = rows.select("path", F.explode(calls).alias("call"))
    modules = calls.select("path", F.lower(F.regexp_extract("call", r"^(Public|Private|DynamicallyLoaded)", 1)).alias("visibility"), F.explode(F.regexp_extract_all("call", F.lit(r'"(\w+)"'), F.lit(1))).alias("module"))
    return modules.select("path", "module", "visibility").distinct()

"""Import, name and base resolution as tiers of equi-joins.

Nothing is decided row by row: what is looked up is first made distinct (file, name, call or not), candidates are
counted per key before they are joined, and of all tiers that answer the first wins.
"""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import dotted_depth, join_path, normalize_path, parent_dir, path_suffixes, tail
from cairn.operators.orphans import script_candidates
from cairn.operators.relational import CALLABLE, TYPES, Index, enclosing_symbols, upsert_edges

# Names so common in a language that a match in a file that isn't imported means nothing; from the languages' own libraries.
_SCRIPT = """log error warn push pop shift map filter forEach reduce find some every includes indexOf join split slice splice concat sort keys values
entries get set has add delete clear then catch finally resolve reject call apply bind toString valueOf parse stringify length test exec replace trim""".split()
_JAVA = "get set add put remove size isEmpty contains equals hashCode toString valueOf length stream map filter collect forEach close run call print println format debug info warn error".split()
UBIQUITOUS = {
    "python": sorted(n for n in {*dir(builtins), *dir(list), *dir(dict), *dir(str), *dir(set)} if not n.startswith("_")),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": _JAVA,
    "c_sharp": "Add Remove Contains Count ToString Equals GetHashCode Select Where First Any All ToList ToArray Debug Info Warn Error Write WriteLine Dispose".split(),
    "go": "append cap close copy delete len make new panic print println recover Error String Println Printf Sprintf Errorf".split(),
    "rust": "new clone iter map filter collect unwrap expect get insert push len is_empty into from to_string default cloned unwrap_or_default".split(),
    "cpp": "begin end size empty push_back pop_back find insert erase clear at front back first second move swap make_pair".split(),
    "ruby": "new each map select reject find puts print raise require nil? to_s to_i to_a size length push pop first last include? fetch".split(),
    "gdscript": "get set has append erase size clear push_error push_warning print emit connect is_empty duplicate".split(),
}


def ubiquitous(ix: Index) -> DataFrame:
    rows = [(lang, name) for lang, names in UBIQUITOUS.items() for name in names]
    return ix.spark.createDataFrame(rows, "ulang string, uname string")


def import_candidates(lang: Column, path: Column, spec: Column) -> Column:
    """Candidate paths of an import that names files by rule, best first (suffix rules are apart)."""
    here = parent_dir(path)
    root = F.substring_index(path, "/", 1)
    dots = dotted_depth(spec)
    rest = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/")
    up = F.regexp_replace(F.repeat(F.lit("../"), dots - 1), "/$", "")
    relative = normalize_path(join_path(join_path(here, F.when(dots > 1, up).otherwise(F.lit("."))), rest))
    bases = F.when(dots > 0, F.array(relative)).otherwise(F.array(join_path(root, rest), join_path(here, rest)))
    python = F.flatten(F.transform(bases, lambda b: F.transform(F.array(*map(F.lit, [".py", "/__init__.py", ".pyi"])), lambda e: F.concat(b, e))))
    near = normalize_path(join_path(here, spec))
    ruby = F.when(F.startswith(spec, F.lit(".")), F.array(near, F.concat(near, F.lit(".rb")))).otherwise(
        F.array(F.concat(root, F.lit("/lib/"), spec, F.lit(".rb")), F.concat(root, F.lit("/"), spec, F.lit(".rb")))
    )
    godot = F.when(F.startswith(spec, F.lit("res://")), F.array(F.concat(root, F.lit("/"), tail(spec, 7)))).otherwise(
        F.when(F.startswith(spec, F.lit(".")), F.array(near)).otherwise(F.array().cast("array<string>"))
    )
    quoted = F.when(F.startswith(spec, F.lit("<")), F.array().cast("array<string>")).otherwise(F.array(near, join_path(root, spec)))
    none = F.array().cast("array<string>")
    # a path from the repository's root without its ending
    rooted = lambda end: F.when(F.contains(spec, F.lit("/")) & ~F.startswith(spec, F.lit(".")), F.array(F.concat(root, F.lit("/"), spec, F.lit(end)))).otherwise(none)
    segments = F.split(F.regexp_replace(spec, r"^(crate|self|super)::", ""), "::")
    rust_bases = (
        F.when(F.startswith(spec, F.lit("crate::")), F.array(F.concat(root, F.lit("/src")), root))
        .when(F.startswith(spec, F.lit("self::")), F.array(here))
        .when(F.startswith(spec, F.lit("super::")), F.array(parent_dir(here)))
        .otherwise(none)
    )
    both = lambda stem: F.array(F.concat(stem, F.lit(".rs")), F.concat(stem, F.lit("/mod.rs")))
    longest_first = F.sequence(F.size(segments), F.lit(1), F.lit(-1))
    prefixes = lambda b: F.flatten(F.transform(longest_first, lambda k: both(F.concat(b, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")))))
    modules = F.concat(both(near), both(F.concat(root, F.lit("/src/"), tail(spec, 3))))
    rust = F.when(F.startswith(spec, F.lit("./")), modules).otherwise(F.concat(F.flatten(F.transform(rust_bases, prefixes)), rooted(".rs")))
    scripts = F.when(F.startswith(spec, F.lit(".")), script_candidates(path, spec)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(lang.isin("typescript", "javascript"), scripts)
        .when(lang == "python", python)
        .when(lang == "ruby", ruby)
        .when(lang == "gdscript", F.concat(godot, rooted(".gd")))
        .when(lang == "go", rooted(".go"))
        .when(lang == "c_sharp", rooted(".cs"))
        .when(lang == "java", rooted(".java"))
        .when(lang == "cpp", quoted)
        .when(lang == "rust", rust)
        .otherwise(F.array().cast("array<string>"))
    )


def resolve_imports(ix: Index) -> DataFrame:
    """import_id, target_file_id of every import that leads to a file of the index."""
    files = ix.files.select("file_id", "path", "lang")
    rows = ix.imports.select("import_id", "file_id", "specifier").where("specifier is not null").join(files, "file_id")
    by_path = files.groupBy(F.col("path").alias("p")).agg(F.min("file_id").alias("target"))
    listed = rows.select("import_id", F.posexplode(import_candidates(F.col("lang"), F.col("path"), F.col("specifier"))).alias("rank", "c"))
    ruled = listed.join(by_path, F.col("c") == F.col("p")).groupBy("import_id").agg(F.min_by("target", "rank").alias("target_file_id"))
    # java: dots are slashes, and the path must end so in one file only; all suffixes of all files meet in an equi-join
    wanted = rows.where("lang = 'java'").select("import_id", F.concat(F.regexp_replace(F.regexp_replace("specifier", r"\.\*$", ""), r"\.", "/"), F.lit(".java")).alias("suffix"))
    ends = files.where("lang = 'java'").select("file_id", F.explode(path_suffixes(F.col("path"))).alias("suffix"))
    unique = ends.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("target_file_id")).where("n = 1").drop("n")
    java = wanted.join(unique, "suffix").select("import_id", "target_file_id")
    # go: a package is a folder and stands for its first file; c_sharp: the first file that declares the namespace;
    # cpp: a base name that only one file of the repository has
    top = lambda c: F.substring_index(c, "/", 1)
    first = lambda df, *keys: df.groupBy(*keys).agg(F.min_by("file_id", F.struct("path", "file_id")).alias("target_file_id"))
    folders = first(files.where("endswith(path, '.go')").select("file_id", "path", parent_dir(F.col("path")).alias("folder")), "folder")
    inside = (F.col("specifier") == top("path")) | F.startswith("specifier", F.concat(top("path"), F.lit("/")))
    asked = rows.where("lang = 'go'").where(inside | F.contains("specifier", F.lit("/")))
    go = asked.select("import_id", F.when(inside, F.col("specifier")).otherwise(F.concat(top("path"), F.lit("/"), "specifier")).alias("folder"))
    go = go.join(folders, "folder").select("import_id", "target_file_id")
    spaces = ix.symbols.where("kind = 'namespace'").select("file_id", F.coalesce("qualified_name", "name").alias("space")).join(files.where("lang = 'c_sharp'"), "file_id")
    spaces = first(spaces.select("file_id", "path", top("path").alias("root"), "space"), "root", "space")
    using = rows.where("lang = 'c_sharp'").select("import_id", top("path").alias("root"), F.regexp_replace(F.regexp_replace("specifier", r"^static\s+", ""), r"^\w+\s*=\s*", "").alias("space"))
    c_sharp = using.join(spaces, ["root", "space"]).select("import_id", "target_file_id")
    bases = files.groupBy(top("path").alias("root"), F.substring_index("path", "/", -1).alias("base")).agg(F.countDistinct("file_id").alias("n"), F.min("file_id").alias("target_file_id")).where("n = 1")
    quoted = rows.where("lang = 'cpp' and not startswith(specifier, '<')").select("import_id", top("path").alias("root"), F.substring_index("specifier", "/", -1).alias("base"))
    cpp = quoted.join(bases, ["root", "base"]).select("import_id", "target_file_id")
    rest = java.unionByName(go).unionByName(c_sharp).unionByName(cpp).join(ruled, "import_id", "left_anti")
    return ruled.unionByName(rest.dropDuplicates(["import_id"]))


def seen_without_import(ix: Index, most: int = 50) -> DataFrame:
    """file_id, target: what a C# file sees of its repository besides single files: its own namespaces and those it uses.

    Namespaces of more than ``most`` files show none of them.
    """
    files = ix.files.where("lang = 'c_sharp'").select("file_id", F.substring_index("path", "/", 1).alias("root"))
    spaces = ix.symbols.where("kind = 'namespace'").select("file_id", F.coalesce("qualified_name", "name").alias("space")).join(files, "file_id").distinct()
    sizes = spaces.groupBy("root", "space").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    members = spaces.join(sizes.select("root", "space"), ["root", "space"]).select("root", "space", F.col("file_id").alias("target"))
    bare = F.regexp_replace(F.regexp_replace("specifier", r"^static\s+", ""), r"^\w+\s*=\s*", "")
    used = ix.imports.where("specifier is not null").select("file_id", bare.alias("space")).join(files, "file_id").select("file_id", "root", "space")
    pairs = used.unionByName(spaces.select("file_id", "root", "space")).distinct().join(members, ["root", "space"])
    return pairs.where("file_id <> target").select("file_id", "target").distinct()


def _stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of the candidates under each key: how many, how many callable, and the lowest id of either."""
    call = F.col("kind").isin(CALLABLE)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(call).alias("n_call"), F.min("symbol_id").alias("low"), F.min(F.when(call, F.col("symbol_id"))).alias("low_call")
    )


def _preferred(df: DataFrame) -> DataFrame:
    """n and symbol_id after a call's preference for what can be called."""
    calls = F.col("is_call") & (F.col("n_call") > 0)
    return df.select("file_id", "name", "is_call", F.when(calls, F.col("n_call")).otherwise(F.col("n")).alias("n"), F.when(calls, F.col("low_call")).otherwise(F.col("low")).alias("symbol_id"))


def resolve_names(ix: Index) -> DataFrame:
    """file_id, name, is_call, symbol_id, confidence, tier for every name used in a file that can be resolved.

    Tiers: 1 bound by an import (0.90); 2 same file (0.85, or 0.70 if several); 3 exported in an imported file or one of a
    namespace in sight (0.70, or 0.50 if several); 4 exported anywhere (0.60, or 0.35 for two to four). Several: the lowest id. Common names stop after 2.
    """
    uses = ix.raw("occurrences", "file_id", "name", "role").where("name is not null and file_id is not null")
    uses = uses.select("file_id", "name", (F.col("role") == "call").alias("is_call")).distinct()
    symbols = ix.symbols.select("symbol_id", "file_id", "name", "kind", "is_exported").where("name is not null")
    shown = symbols.where("is_exported")
    imports = ix.imports.where("resolved_file_id is not null").select("import_id", "file_id", "names", "resolved_file_id")

    bound = imports.select("file_id", "import_id", "resolved_file_id", F.explode("names").alias("name")).where("name <> '*'")
    bound = bound.groupBy("file_id", "name").agg(F.max_by("resolved_file_id", "import_id").alias("target"))
    by_file = _stats(shown.withColumnRenamed("file_id", "target"), ["target", "name"])
    t1 = _preferred(uses.join(bound, ["file_id", "name"]).join(by_file, ["target", "name"])).select("file_id", "name", "is_call", "symbol_id", F.lit(0.9).alias("confidence"), F.lit(1).alias("tier"))

    t2 = _preferred(uses.join(_stats(symbols, ["file_id", "name"]), ["file_id", "name"])).select(
        "file_id", "name", "is_call", "symbol_id", F.when(F.col("n") == 1, 0.85).otherwise(0.7).alias("confidence"), F.lit(2).alias("tier")
    )

    common = F.broadcast(ubiquitous(ix))  # a fixed list of a few hundred words
    langs = ix.files.select("file_id", "lang")
    rest = uses.join(langs, "file_id").join(common, (F.col("lang") == F.col("ulang")) & (F.col("name") == F.col("uname")), "left_anti").drop("lang")
    targets = imports.select("file_id", F.col("resolved_file_id").alias("target")).unionByName(seen_without_import(ix)).distinct()
    near = rest.join(targets, "file_id").join(by_file, ["target", "name"]).groupBy("file_id", "name", "is_call").agg(
        F.sum("n").alias("n"), F.sum("n_call").alias("n_call"), F.min("low").alias("low"), F.min("low_call").alias("low_call")
    )
    t3 = _preferred(near).select("file_id", "name", "is_call", "symbol_id", F.when(F.col("n") == 1, 0.7).otherwise(0.5).alias("confidence"), F.lit(3).alias("tier"))
    t4 = _preferred(rest.join(_stats(shown, ["name"]), "name")).where("n <= 4").select(
        "file_id", "name", "is_call", "symbol_id", F.when(F.col("n") == 1, 0.6).otherwise(0.35).alias("confidence"), F.lit(4).alias("tier")
    )
    every = t1.unionByName(t2).unionByName(t3).unionByName(t4)
    return every.groupBy("file_id", "name", "is_call").agg(F.min_by(F.struct("symbol_id", "confidence", "tier"), "tier").alias("r")).select("file_id", "name", "is_call", "r.*")


def resolve_occurrences(ix: Index) -> DataFrame:
    """occ_id, symbol_id, confidence: the resolved names back on their occurrences."""
    occ = ix.occurrences.select("occ_id", "file_id", "name", (F.col("role") == "call").alias("is_call"))
    return occ.join(resolve_names(ix).drop("tier"), ["file_id", "name", "is_call"]).select("occ_id", "symbol_id", "confidence")


def resolve_bases(ix: Index) -> DataFrame:
    """symbol_id, base_name, base_kind, base_symbol_id, confidence of every base type that can be resolved.

    Each base is looked up as written, then by its last segment: same file 0.90, the file that an import binds the name to
    0.90, imported files 0.85, anywhere 0.70 if unique, 0.40 for two to four, but not for names common in the file's
    language; never the symbol itself.
    """
    symbols = ix.symbols.select("symbol_id", "file_id", "name", "kind", "is_exported", "bases")
    wants = symbols.where("bases is not null").select("symbol_id", "file_id", F.explode("bases").alias("b")).select("symbol_id", "file_id", "b.name", "b.kind").where("name is not null").distinct()
    last = F.element_at(F.split("name", r"::|\."), -1)
    forms = wants.select("symbol_id", "file_id", F.col("name").alias("base_name"), F.col("kind").alias("base_kind"), F.posexplode(F.array_distinct(F.array("name", last))).alias("form", "look"))
    types = symbols.where(F.col("kind").isin(TYPES)).select(F.col("symbol_id").alias("tid"), F.col("file_id").alias("tfile"), F.col("name").alias("look"), "is_exported")
    targets = ix.imports.where("resolved_file_id is not null").select("file_id", F.col("resolved_file_id").alias("tfile")).distinct()
    keys = ["symbol_id", "file_id", "base_name", "base_kind", "form"]
    local = forms.join(types.withColumnRenamed("tfile", "file_id"), ["file_id", "look"]).where("tid <> symbol_id").groupBy(*keys).agg(F.min("tid").alias("tid")).select(*keys, "tid", F.lit(0.9).alias("confidence"), F.lit(1).alias("tier"))
    shown = types.where("is_exported")
    near = forms.join(targets, "file_id").join(shown, ["tfile", "look"]).where("tid <> symbol_id").groupBy(*keys).agg(F.min("tid").alias("tid")).select(*keys, "tid", F.lit(0.85).alias("confidence"), F.lit(3).alias("tier"))
    named = ix.imports.where("resolved_file_id is not null").select("import_id", "file_id", "resolved_file_id", F.explode("names").alias("look")).where("look <> '*'")
    named = named.groupBy("file_id", "look").agg(F.max_by("resolved_file_id", "import_id").alias("tfile"))
    bound = forms.join(named, ["file_id", "look"]).join(shown, ["tfile", "look"]).where("tid <> symbol_id").groupBy(*keys).agg(F.min("tid").alias("tid")).select(*keys, "tid", F.lit(0.9).alias("confidence"), F.lit(2).alias("tier"))
    per_name = shown.groupBy("look").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("tid")).where("n <= 4")
    common = F.broadcast(ubiquitous(ix))  # a fixed list of a few hundred words
    rare = forms.join(ix.files.select("file_id", "lang"), "file_id").join(common, (F.col("lang") == F.col("ulang")) & (F.col("look") == F.col("uname")), "left_anti")
    far = rare.join(per_name, "look").where("tid <> symbol_id").select(*keys, "tid", F.when(F.col("n") == 1, 0.7).otherwise(0.4).alias("confidence"), F.lit(4).alias("tier"))
    every = local.unionByName(bound).unionByName(near).unionByName(far)
    best = every.groupBy("symbol_id", "base_name", "base_kind").agg(F.min_by(F.struct("tid", "confidence"), F.struct("form", "tier")).alias("r"))
    return best.select("symbol_id", "base_name", "base_kind", F.col("r.tid").alias("base_symbol_id"), F.col("r.confidence").alias("confidence"))


def call_edges(ix: Index) -> DataFrame:
    """Edges from the innermost symbol around each resolved call to what it calls, one for each pair."""
    rows = enclosing_symbols(ix).where("enclosing_symbol_id <> resolved_symbol_id")
    edges = rows.select(
        F.col("enclosing_symbol_id").alias("src_symbol_id"), F.col("resolved_symbol_id").alias("dst_symbol_id"), F.lit("calls").alias("kind"), "confidence", F.lit("index").alias("provenance")
    )
    return upsert_edges(edges)


def type_edges(ix: Index) -> DataFrame:
    bases = resolve_bases(ix)
    edges = bases.select(F.col("symbol_id").alias("src_symbol_id"), F.col("base_symbol_id").alias("dst_symbol_id"), F.col("base_kind").alias("kind"), "confidence", F.lit("index").alias("provenance"))
    return upsert_edges(edges)


def promote_edges(edges: DataFrame, sites: DataFrame, facts: DataFrame, most: float = 0.6) -> DataFrame:
    """Edges after precise facts about call sites.

    sites: src_symbol_id, dst_symbol_id, file_id, line, col, the place an unsure call edge is judged by. facts: file_id,
    line, col, target (the symbol that is really called there). A fact that confirms an edge makes it (1.0, lsp); one that
    names another symbol puts that edge in the place of the wrong one; an edge without a fact stays as it is.
    """
    low = edges.where((F.col("kind") == "calls") & (F.col("provenance") == "index") & (F.col("confidence") <= most))
    known = facts.where("target is not null").groupBy("file_id", "line", "col").agg(F.min("target").alias("target"))
    told = low.select("src_symbol_id", "dst_symbol_id").join(sites, ["src_symbol_id", "dst_symbol_id"]).join(known, ["file_id", "line", "col"])
    told = told.groupBy("src_symbol_id", "dst_symbol_id").agg(F.min("target").alias("target"))
    gone = told.select(F.col("src_symbol_id").alias("ts"), F.col("dst_symbol_id").alias("td"), F.lit("calls").alias("tk"))
    keep = edges.join(gone, (F.col("src_symbol_id") == F.col("ts")) & (F.col("dst_symbol_id") == F.col("td")) & (F.col("kind") == F.col("tk")), "left_anti")
    new = told.select("src_symbol_id", F.col("target").alias("dst_symbol_id"), F.lit("calls").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("lsp").alias("provenance"))
    return upsert_edges(keep.select(*new.columns).unionByName(new))


def first_sites(ix: Index, edges: DataFrame) -> DataFrame:
    """src_symbol_id, dst_symbol_id, file_id, line, col: the first call inside the source's lines that resolves to the target."""
    span = ix.symbols.select(F.col("symbol_id").alias("src_symbol_id"), "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    calls = ix.occurrences.where("role = 'call' and resolved_symbol_id is not null").select("file_id", F.col("resolved_symbol_id").alias("dst_symbol_id"), "start_line", "start_col")
    met = edges.select("src_symbol_id", "dst_symbol_id").join(span, "src_symbol_id").join(calls, ["file_id", "dst_symbol_id"]).where("start_line between a and z")
    first = met.groupBy("src_symbol_id", "dst_symbol_id", "file_id").agg(F.min(F.struct("start_line", "start_col")).alias("p"))
    return first.select("src_symbol_id", "dst_symbol_id", "file_id", F.col("p.start_line").alias("line"), F.col("p.start_col").alias("col"))

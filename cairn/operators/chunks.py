"""Chunks of code as text, near copies among them by word shingles, and names that hold a phrase.

A chunk is what a symbol looks like to a search: its path, kind and qualified name, signature, documentation and body (or
its members). Near copies are found exactly: texts with the same set of shingles are one class, and classes meet over
their rarest shingles only (as many as any two sets of the wanted similarity must share one of), then are compared whole.

Defined results: chunks under 24 characters are dropped; texts of fewer than five words have no shingles and no links;
null parts of a chunk are left out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.lookups import top
from cairn.operators.relational import Index
from cairn.session import Scratch

CONTAINERS = ["class", "struct", "interface", "trait", "enum", "impl", "namespace", "module"]
LEAVES = ["function", "method", "constructor", "macro", "variable", "constant", "type_alias"]
BODY, DOC, MEMBERS, SHORTEST = 1400, 500, 40, 24  # Fixed values: characters and names that a chunk takes
SHINGLE = 5


def chunks(ix: Index) -> DataFrame:
    """symbol_id, text: one chunk for each symbol that is a leaf or a container."""
    texts = ix.raw("sources", "path", "content").where("content is not null").dropDuplicates(["path"])
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n").alias("lines")
    files = ix.files.select("file_id", "path").join(texts, "path", "left").select("file_id", "path", lines)
    sym = ix.symbols.where(F.col("kind").isin(LEAVES + CONTAINERS))
    members = ix.symbols.where("parent_symbol_id is not null and name is not null").select(F.col("parent_symbol_id").alias("owner"), "start_line", "start_col", "symbol_id", "name")
    members = top(members, ["owner"], ["start_line", "start_col", "symbol_id"], MEMBERS)
    members = members.groupBy("owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda m: m["name"]), ", ").alias("names"))
    rows = sym.join(files, "file_id").join(members, F.col("symbol_id") == F.col("owner"), "left")
    whole = F.array_join(F.slice("lines", F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    body = F.when(F.col("kind").isin(CONTAINERS), F.concat(F.lit("members: "), "names")).otherwise(F.substring(whole, 1, BODY))
    title = F.concat("kind", F.lit(" "), F.coalesce("qualified_name", "name"))
    text = F.concat_ws("\n", "path", title, "signature", F.substring("doc_comment", 1, DOC), body)
    return rows.select("symbol_id", text.alias("text")).where(F.length("text") >= SHORTEST)


def bodies(ix: Index) -> DataFrame:
    """symbol_id, text of all functions, methods and constructors, whole."""
    texts = ix.raw("sources", "path", "content").where("content is not null").dropDuplicates(["path"])
    files = ix.files.select("file_id", "path").join(texts, "path").select("file_id", F.split(F.regexp_replace("content", "\r\n", "\n"), "\n").alias("lines"))
    sym = ix.symbols.where("kind in ('function', 'method', 'constructor') and start_line >= 1 and end_line >= start_line").select("symbol_id", "file_id", "start_line", "end_line")
    return sym.join(files, "file_id").select("symbol_id", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("text"))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and _."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: x != "")


def shingles(w: Column) -> Column:
    """The distinct runs of five words of an array of words, hashed to 64 bits."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, SHINGLE), " ")))
    return F.when(F.size(w) >= SHINGLE, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def near_copies(texts: DataFrame, id_col: str, text_col: str, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id, n) and pairs of classes (a < b, jaccard) whose shingle sets are at least so similar."""
    scratch = Scratch(texts.sparkSession, "copies")
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    # the words of a text are made once, before its runs of them
    rows = scratch.save(rows.select("id", words(F.col("text")).alias("w")), "words")
    rows = rows.select("id", F.sort_array(shingles(F.col("w"))).alias("s")).where(F.size("s") > 0)
    # one row a distinct set; the set itself is the key, shortened to its sha-256
    rows = scratch.save(rows.withColumn("sha", F.sha2(F.to_json("s"), 256)), "sets")
    classes = scratch.save(rows.groupBy("sha").agg(F.min("id").alias("class_id"), F.first("s").alias("s")), "classes")
    members = rows.select("id", "sha").join(classes.select("sha", "class_id"), "sha").select("id", "class_id")
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    members = scratch.save(members.join(sizes, "class_id").select("id", "class_id", "n"), "members")
    # prefixes: two sets of similarity t share one of the first size - ceil(t * size) + 1 shingles, rarest first
    flat = classes.select("class_id", F.size("s").alias("size"), F.explode("s").alias("g"))
    common = flat.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = flat.join(common, "g", "left").groupBy("class_id", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "g"))).alias("o"))
    length = (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int")
    prefix = ordered.select("class_id", "size", F.posexplode(F.slice("o", F.lit(1), length)).alias("at", "p")).where("p.df > 1")
    prefix = scratch.save(prefix.select("class_id", "size", "at", F.col("p.g").alias("g")), "prefixes")
    left = prefix.select(F.col("class_id").alias("a"), F.col("size").alias("na"), F.col("at").alias("pa"), "g")
    right = prefix.select(F.col("class_id").alias("b"), F.col("size").alias("nb"), F.col("at").alias("pb"), "g")
    # what can still be shared from here on must be enough
    need = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) + F.least("pa", "pb") >= need)
    met = left.join(right, "g").where("a < b").where(fits).select("a", "b").distinct()
    sets = classes.select("class_id", "s")
    both = met.join(sets.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    jaccard = shared / (F.size("sa") + F.size("sb") - shared)
    pairs = both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= least - 1e-12)
    return members, scratch.save(pairs, "pairs")


def near_copy_links(ix: Index, least: float = 0.8) -> DataFrame:
    """symbol_id, class_id, n_copies, n_links: the class of equal shingles of every function and how many others are near."""
    members, pairs = near_copies(bodies(ix), "symbol_id", "text", least)
    sizes = members.select("class_id", "n").distinct()
    ways = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    across = ways.join(sizes.select(F.col("class_id").alias("other"), F.col("n").alias("m")), "other").groupBy("class_id").agg(F.sum("m").alias("m"))
    return members.join(across, "class_id", "left").select(
        F.col("id").alias("symbol_id"), "class_id", F.col("n").alias("n_copies"), (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )


def names_holding(names: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, name: the names (name) that hold a phrase (phrase), whatever the case of ASCII letters.

    Both meet over one run of up to three characters: the phrase's rarest among the names.
    """
    low = lambda c: F.translate(F.col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(c: Column, n: int) -> Column:
        return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    named = names.select("name").where("name is not null").distinct().withColumn("n", low("name"))
    asked = phrases.select("phrase").where("phrase <> ''").distinct().withColumn("p", low("phrase"))
    size = F.least(F.length("p"), F.lit(3))
    cut = F.when(size == 3, grams(F.col("p"), 3)).when(size == 2, grams(F.col("p"), 2)).otherwise(grams(F.col("p"), 1))
    asked = asked.select("phrase", "p", F.explode(cut).alias("g"))
    held = named.select("name", "n", F.explode(F.concat(grams(F.col("n"), 1), grams(F.col("n"), 2), grams(F.col("n"), 3))).alias("g")).join(asked.select("g").distinct(), "g", "left_semi")
    df = held.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # a run that no name holds rules the phrase out
    rare = asked.join(df, "g", "left").groupBy("phrase", "p").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("g"))
    return rare.join(held, "g").where(F.contains("n", F.col("p"))).select("phrase", "name")

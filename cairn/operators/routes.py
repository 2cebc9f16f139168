"""Web routes: paths, patterns, URLs, file conventions, handlers.

A routes table has framework, method, path, full_path (may be null), handler_name, handler_line, file_id. Null paths are
no routes; methods ``ANY`` and null answer every method; order is by full path (or path), then method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.paths import base_name, parent_dir, path_ancestors, tail

CALLABLES = ["function", "method", "constructor"]
# Which package of an import tells which framework, the first that is found deciding.
FRAMEWORKS = {
    "typescript": [("nestjs", r"^@nestjs/"), ("express", r"^express$"), ("fastify", r"^fastify$")],
    "python": [("fastapi", r"^fastapi(\.|$)"), ("flask", r"^flask(\.|$)"), ("django", r"^django(\.|$)")],
}
FRAMEWORKS["javascript"] = FRAMEWORKS["typescript"]
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]  # Fixed values: HTTP verbs


def join_route_paths(*parts: Column) -> Column:
    """Pieces of a route with one slash between them and one in front; none at the end."""
    bare = F.array_join(F.filter(F.array(*[F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", "") for p in parts]), lambda x: x != ""), "/")
    return F.concat(F.lit("/"), bare)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _is_rest(s: Column) -> Column:
    return s.rlike(r"^(\*.*|\[\[?\.\.\..*\]|:\w+\*|\{\w+:path\}|<path:\w+>)$")


def _is_parameter(s: Column) -> Column:
    return s.rlike(r"^(:\w+.*|\{.*\}|<.*>|\[.*\])$")


def route_pattern(path: Column) -> Column:
    """The regular expression of the URL paths a route answers."""
    literal = lambda s: F.regexp_replace(s, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    one = lambda s: F.when(_is_rest(s), F.lit("/.*")).when(_is_parameter(s), F.lit("/[^/]+")).otherwise(F.concat(F.lit("/"), literal(s)))
    return F.concat(F.lit("^"), F.array_join(F.transform(_segments(path), one), ""), F.lit("/?$"))


def static_segments(path: Column) -> Column:
    """How many segments of a route are literal."""
    return F.size(F.filter(_segments(path), lambda s: ~_is_rest(s) & ~_is_parameter(s)))


def match_urls(routes: DataFrame, urls: DataFrame) -> DataFrame:
    """url, method, path, route_method of the route that answers each URL (url, method): the one with most literal segments.

    Both meet by number of segments and first segment (literal or any), routes with a rest by first segment only; so no
    URL meets every route. Queries and fragments of URLs don't count.
    """
    full = F.coalesce("full_path", "path")
    known = routes.where(full.isNotNull()).select(full.alias("path"), F.upper("method").alias("route_method")).distinct()
    seg = _segments(F.col("path"))
    first = F.element_at(F.concat(seg, F.array(F.lit(""))), 1)
    rest = F.exists(seg, _is_rest)
    fixed = ~_is_parameter(first) & ~_is_rest(first)
    known = known.select(
        "path", "route_method", F.when(fixed, first).otherwise(F.lit("*")).alias("first"), F.when(rest, F.lit(-1)).otherwise(F.size(seg)).alias("n"),
        route_pattern(F.col("path")).alias("pattern"), static_segments(F.col("path")).alias("n_static"),
    )
    asked = urls.where("url is not null").select("url", F.upper("method").alias("method")).distinct()
    bare = F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "")
    useg = _segments(bare)
    head = F.element_at(F.concat(useg, F.array(F.lit(""))), 1)
    asked = asked.select("url", "method", F.concat(F.lit("/"), F.array_join(useg, "/")).alias("u"), F.explode(F.array(head, F.lit("*"))).alias("first"), F.size(useg).alias("m"))
    asked = asked.select("url", "method", "u", "first", F.explode(F.array("m", F.lit(-1))).alias("n"))
    met = asked.join(known, ["first", "n"]).where(F.expr("u rlike pattern"))
    met = met.where(F.col("route_method").isNull() | F.col("route_method").isin("ANY", "USE") | F.col("method").isNull() | (F.col("route_method") == F.col("method")))
    best = Window.partitionBy("url", "method").orderBy(F.desc("n_static"), F.when(F.col("route_method") == F.col("method"), 0).otherwise(1), "path", "route_method")
    return met.withColumn("at", F.row_number().over(best)).where("at = 1").select("url", "method", "path", "route_method")


def list_routes(routes: DataFrame, framework: str | None = None, method: str | None = None, holding: str | None = None) -> DataFrame:
    """Routes of a framework and method whose path holds a text, each with its place in the order."""
    full = F.coalesce("full_path", "path")
    rows = routes.where(full.isNotNull())
    if framework is not None:
        rows = rows.where(F.col("framework") == framework)
    if method is not None:
        rows = rows.where(F.col("method").isNull() | F.upper("method").isin(method.upper(), "ANY"))
    if holding is not None:
        rows = rows.where(F.contains(F.lower("path"), F.lit(holding.lower())) | F.contains(F.lower(full), F.lit(holding.lower())))
    return rows.orderBy(full, "method")


def route_stats(routes: DataFrame) -> DataFrame:
    return routes.groupBy("framework").agg(F.count(F.lit(1)).alias("n_routes"), F.count_if(F.col("handler_name").isNotNull() & F.col("handler_id").isNull()).alias("n_open"))


def bind_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """The routes with handler_id: the smallest callable around the handler's line; else the one of its name's last segment.

    By name the file's own callable or class wins if it is the only one there, else the only one anywhere.
    """
    rows = routes.withColumn("rid", F.struct("file_id", "path", "method", "handler_name", "handler_line"))
    spans = symbols.where(F.col("kind").isin(CALLABLES)).select(F.col("file_id").alias("sfile"), F.col("symbol_id").alias("sid"), F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    around = rows.join(spans, (F.col("file_id") == F.col("sfile")) & F.col("handler_line").between(F.col("a"), F.col("z")))
    around = around.groupBy("rid").agg(F.min_by("sid", F.struct((F.col("z") - F.col("a")).alias("size"), "sid")).alias("by_line"))
    last = F.element_at(F.split("handler_name", r"\."), -1)
    named = symbols.where(F.col("kind").isin([*CALLABLES[:2], "class"])).select(F.col("name").alias("look"), F.col("file_id").alias("sfile"), F.col("symbol_id").alias("sid"))
    here = named.groupBy("look", "sfile").agg(F.count(F.lit(1)).alias("n_here"), F.min("sid").alias("one_here"))
    everywhere = named.groupBy("look").agg(F.count(F.lit(1)).alias("n_all"), F.min("sid").alias("one_all"))
    asked = rows.where("handler_name is not null").select("rid", "file_id", last.alias("look")).distinct()
    asked = asked.join(here, (F.col("file_id") == F.col("sfile")) & (here["look"] == asked["look"]), "left").drop(here["look"]).join(everywhere, "look", "left")
    by_name = asked.select(F.col("rid").alias("nid"), F.when(F.col("n_here") == 1, F.col("one_here")).when(F.col("n_all") == 1, F.col("one_all")).alias("by_name"))
    out = rows.join(around.withColumnRenamed("rid", "lid"), F.col("rid").eqNullSafe(F.col("lid")), "left").join(by_name, F.col("rid").eqNullSafe(F.col("nid")), "left")
    return out.select(*[c for c in routes.columns if c != "handler_id"], F.coalesce("by_line", "by_name").alias("handler_id"))


def routes_by_handler(routes: DataFrame) -> DataFrame:
    """handler_id, routes: what each handler answers, in order."""
    label = F.concat(F.coalesce("method", F.lit("ANY")), F.lit(" "), F.coalesce("full_path", "path"))
    return routes.where("handler_id is not null").groupBy("handler_id").agg(F.array_sort(F.collect_set(label)).alias("routes"))


def frameworks(files: DataFrame, imports: DataFrame) -> DataFrame:
    """file_id, framework of every file whose imports name one; files called urls.py are django's."""
    rows = files.select("file_id", "lang", "path").join(imports.select("file_id", "specifier"), "file_id", "left")
    place = F.lit(None).cast("struct<at:int,framework:string>")
    for lang, known in FRAMEWORKS.items():
        for at, (name, pattern) in enumerate(known):
            hit = (F.col("lang") == lang) & F.col("specifier").rlike(pattern)
            place = F.when(hit, F.struct(F.lit(at).alias("at"), F.lit(name).alias("framework"))).otherwise(place)
    urls = (F.col("lang") == "python") & (base_name(F.col("path")) == "urls.py")
    place = F.coalesce(place, F.when(urls, F.struct(F.lit(9).alias("at"), F.lit("django").alias("framework"))))
    return rows.groupBy("file_id").agg(F.min(place).alias("f")).where("f is not null").select("file_id", "f.framework")


def file_routes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, framework, path, shape, method of routes that follow from where files lie.

    The nearest folder above with a framework's configuration file decides: next (``app`` and ``pages`` folders),
    sveltekit (``src/routes``), nuxt (``pages``, ``server/api``) and remix (``app/routes``). Pages answer GET; of server
    files each exported verb is a route, ANY if there is none.
    """
    name = base_name(F.col("path"))
    mark = F.when(name.rlike(r"^next\.config\."), "next").when(name.rlike(r"^svelte\.config\."), "sveltekit").when(name.rlike(r"^nuxt\.config\."), "nuxt").when(name.rlike(r"^remix\.config\."), "remix")
    marks = files.select(parent_dir(F.col("path")).alias("root"), mark.alias("framework")).where("framework is not null").distinct()
    above = files.select("file_id", "path", F.explode(path_ancestors(F.col("path"))).alias("root")).join(marks, "root")
    near = above.groupBy("file_id", "path").agg(F.max(F.struct(F.length("root").alias("n"), "root", "framework")).alias("m")).select("file_id", "path", "m.root", "m.framework")
    inner = F.regexp_replace(F.when(F.col("root") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("root") + 2, F.length("path"))), "^src/", "")
    rows = near.withColumn("inner", inner)
    stem = lambda pattern: F.nullif(F.regexp_extract("inner", pattern, 1), F.lit(""))
    is_ = lambda fw, pattern: (F.col("framework") == fw) & F.col("inner").rlike(pattern)
    source = r"\.(?:tsx?|jsx?|mjs|vue)$"
    shape = (
        F.when(is_("next", r"^app/(?:.*/)?route\.[jt]s$"), "server").when(is_("next", r"^app/(?:.*/)?page" + source), "page")
        .when(is_("next", r"^pages/api/.*" + source), "api").when(is_("next", r"^pages/(?!_).*" + source), "page")
        .when(is_("sveltekit", r"^routes/(?:.*/)?\+server\.[jt]s$"), "server").when(is_("sveltekit", r"^routes/(?:.*/)?\+page\.svelte$"), "page")
        .when(is_("nuxt", r"^server/(?:api|routes)/.*\.[jt]s$"), "api").when(is_("nuxt", r"^pages/.*\.vue$"), "page")
        .when(is_("remix", r"^app/routes/.*" + source), "page")
    )
    place = (
        F.when(F.col("inner").rlike(r"^app/(?:.*/)?(?:route|page)\."), F.coalesce(stem(r"^app/(.*)/(?:route|page)\.[^/]*$"), F.lit("")))
        .when(F.col("framework") == "sveltekit", F.coalesce(stem(r"^routes/(.*)/\+[^/]*$"), F.lit("")))
        .when(F.col("inner").startswith("server/"), F.regexp_replace(F.regexp_replace(stem(r"^server/(.*)\.[^./]*$"), "^routes/", ""), r"\.(get|post|put|patch|delete|head|options)$", ""))
        .when(F.col("framework") == "remix", F.regexp_replace(F.regexp_replace(stem(r"^app/routes/(.*)\.[^./]*$"), r"\.", "/"), r"(^|/)_index$", ""))
        .otherwise(stem(r"^pages/(.*)\.[^./]*$"))
    )
    # groups in brackets and names with an underscore in front are no part of the address; index is the folder itself
    kept = F.filter(F.split(place, "/"), lambda s: ~s.rlike(r"^\(.*\)$|^@") & ~s.isin("", "index"))
    turned = F.transform(
        kept,
        lambda s: F.when(s.rlike(r"^\[\[?\.\.\.(.+?)\]\]?$"), F.concat(F.lit("*"), F.regexp_extract(s, r"^\[\[?\.\.\.(.+?)\]", 1)))
        .when(s.rlike(r"^\[.+\]$"), F.concat(F.lit(":"), F.regexp_extract(s, r"^\[+(.+?)\]", 1)))
        .when(s == "$", F.lit("*")).when(s.startswith("$"), F.concat(F.lit(":"), tail(s, 2)))
        .otherwise(s),
    )
    rows = rows.select("file_id", "framework", shape.alias("shape"), F.concat(F.lit("/"), F.array_join(turned, "/")).alias("path"), F.upper(F.regexp_extract("inner", r"\.(get|post|put|patch|delete|head|options)\.[jt]s$", 1)).alias("told")).where("shape is not null")
    verbs = symbols.where(F.col("is_exported") & F.col("name").isin(VERBS)).select("file_id", F.col("name").alias("verb")).distinct()
    servers = rows.where("shape = 'server'").join(verbs, "file_id", "left").select("file_id", "framework", "path", "shape", F.coalesce("verb", F.lit("ANY")).alias("method"))
    told = F.when(F.col("told") != "", F.col("told"))
    rest = rows.where("shape <> 'server'").select("file_id", "framework", "path", "shape", F.coalesce(told, F.when(F.col("shape") == "page", F.lit("GET")).otherwise(F.lit("ANY"))).alias("method"))
    return servers.unionByName(rest)

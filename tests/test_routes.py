import pytest
from cairn.operators import routes as r
from pyspark.sql import functions as F

SCHEMA = "framework string, method string, path string, full_path string, handler_name string, handler_line int, file_id long"


def test_joining_and_patterns(spark):
    df = spark.createDataFrame([("/api/", "users/"), ("", "/"), (None, ":id"), ("/a", None)], "a string, b string")
    assert [x[0] for x in df.select(r.join_route_paths(F.col("a"), F.col("b"))).collect()] == ["/api/users", "/", "/:id", "/a"]
    paths = ["/users/:id", "/files/*rest", "/a.b/{x}", "/v/<int:n>", "/"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(r.route_pattern(F.col("p")), r.static_segments(F.col("p"))).collect()
    assert [tuple(x) for x in got] == [("^/users/[^/]+/?$", 1), ("^/files/.*/?$", 1), (r"^/a\.b/[^/]+/?$", 1), ("^/v/[^/]+/?$", 1), ("^/?$", 0)]


def test_urls(spark):
    rows = [("express", "GET", "/users/:id"), ("express", "GET", "/users/me"), ("express", "ANY", "/:any/me"), ("express", "POST", "/users/:id"), ("express", None, "/files/*"), ("x", "GET", "/"), ("x", "GET", None)]
    known = spark.createDataFrame([(f, m, p, None, None, None, 1) for f, m, p in rows], SCHEMA)
    urls = spark.createDataFrame([("/users/7?x=1", "get"), ("/users/me", "GET"), ("/users/7", "POST"), ("http://h/files/a/b", "PUT"), ("/", "GET"), ("/none/at/all", "GET"), (None, "GET"), ("/x/me", "DELETE"), ("/users/7", "PUT")], "url string, method string")
    got = {(x["url"], x["method"]): x["path"] for x in r.match_urls(known, urls).collect()}
    assert got == {("/users/7?x=1", "GET"): "/users/:id", ("/users/me", "GET"): "/users/me", ("/users/7", "POST"): "/users/:id", ("http://h/files/a/b", "PUT"): "/files/*", ("/", "GET"): "/", ("/x/me", "DELETE"): "/:any/me"}
    assert r.match_urls(known.limit(0), urls).count() == 0
    assert [x["path"] for x in r.list_routes(known, method="get", holding="USERS").collect()] == ["/users/:id", "/users/me"]


def test_handlers(spark):
    symbols = spark.createDataFrame(
        [(1, 1, "outer", "function", 1, 30), (2, 1, "inner", "function", 5, 9), (3, 1, "show", "function", 40, 41), (4, 2, "show", "method", 1, 2), (5, 2, "only", "class", 5, 9)],
        "symbol_id long, file_id long, name string, kind string, start_line int, end_line int",
    )
    known = spark.createDataFrame(
        [("e", "GET", "/a", None, None, 6, 1), ("e", "GET", "/b", "/x/b", "views.show", None, 1), ("e", "GET", "/c", None, "mod.only", None, 1), ("e", "GET", "/d", None, "show", None, 9), ("e", "GET", "/e", None, None, None, None)], SCHEMA
    )
    bound = r.bind_handlers(known, symbols)
    assert {x["path"]: x["handler_id"] for x in bound.collect()} == {"/a": 2, "/b": 3, "/c": 5, "/d": None, "/e": None}
    assert {x["handler_id"]: x["routes"] for x in r.routes_by_handler(bound).collect()}[3] == ["GET /x/b"]
    assert [tuple(x) for x in r.route_stats(bound).collect()] == [("e", 5, 1)]


def test_frameworks(spark):
    files = spark.createDataFrame([(1, "typescript", "r/a.ts"), (2, "python", "r/b.py"), (3, "python", "r/urls.py"), (4, "go", "r/c.go"), (5, None, None)], "file_id long, lang string, path string")
    imports = spark.createDataFrame([(1, "express"), (1, "@nestjs/common"), (2, "flask"), (2, "django.urls"), (4, "express"), (None, "flask"), (5, None)], "file_id long, specifier string")
    assert {x["file_id"]: x["framework"] for x in r.frameworks(files, imports).collect()} == {1: "nestjs", 2: "flask", 3: "django"}


@pytest.mark.parametrize(
    "root, path, route",
    [
        ("next.config.js", "app/(shop)/items/[id]/page.tsx", ("next", "/items/:id", "page", "GET")), ("next.config.js", "src/pages/index.tsx", ("next", "/", "page", "GET")),
        ("next.config.js", "pages/api/users/[...all].ts", ("next", "/api/users/*all", "api", "ANY")), ("next.config.js", "pages/_app.tsx", None), ("next.config.js", "app/api/x/route.ts", ("next", "/api/x", "server", "POST")),
        ("svelte.config.js", "src/routes/blog/[slug]/+page.svelte", ("sveltekit", "/blog/:slug", "page", "GET")), ("nuxt.config.ts", "server/api/items.post.ts", ("nuxt", "/api/items", "api", "POST")),
        ("nuxt.config.ts", "pages/users/[id].vue", ("nuxt", "/users/:id", "page", "GET")), ("remix.config.js", "app/routes/posts.$id.tsx", ("remix", "/posts/:id", "page", "GET")), ("other.js", "pages/a.tsx", None),
    ],
)
def test_routes_from_places(spark, root, path, route):
    files = spark.createDataFrame([(1, f"w/{root}"), (2, f"w/{path}"), (3, None)], "file_id long, path string")
    symbols = spark.createDataFrame([(2, "POST", True), (2, "helper", True), (2, "GET", False)], "file_id long, name string, is_exported boolean")
    got = [(x["framework"], x["path"], x["shape"], x["method"]) for x in r.file_routes(files, symbols).where("file_id = 2").collect()]
    assert got == ([route] if route else [])

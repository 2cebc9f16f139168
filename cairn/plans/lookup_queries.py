"""Look-ups, maintenance, hierarchies, chunks and near copies over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import chunks, graph, lookups, resolution, retrieval
from cairn.operators.relational import TYPES, Index
from cairn.session import Scratch
from cairn.plans import code_sql
from cairn.plans.code_queries import _name_queries, _on_index
from cairn.plans.code_sql import CHG, CUR, EDG, ENCLOSING, IMP, OCC, SYM, _in, _with


def removed_symbols(ix: Index) -> DataFrame:
    """Every symbol id that was ever dropped, looked up in the order of the ids."""
    ids = ix.raw("removals", "rec_table", "rec_id").where("rec_table = 'symbols' and rec_id is not null").select(F.col("rec_id").alias("symbol_id"), F.col("rec_id").alias("place")).distinct()
    return lookups.batch_symbols(ix, ids)


def changed_symbols(ix: Index) -> DataFrame:
    return ix.symbols.join(graph.changed_files(ix), "file_id", "left_semi").select("symbol_id")


def caller_levels(ix: Index) -> DataFrame:
    return lookups.hierarchy_levels(ix, changed_symbols(ix), ["calls"], 3, 25)


def subtype_levels(ix: Index) -> DataFrame:
    """Subtypes of every symbol that has any, five levels deep."""
    seeds = ix.edges.where("kind in ('extends', 'implements') and dst_symbol_id is not null").select(F.col("dst_symbol_id").alias("symbol_id")).distinct()
    return lookups.hierarchy_levels(ix, seeds, ["extends", "implements"], 5, 50)


def scoped_resolution(ix: Index) -> DataFrame:
    """Edges after the files that the changes touch are resolved again."""
    return lookups.resolution_pass(ix, graph.affected_files(ix), resolution.call_edges(ix))


def chunk_digests(ix: Index) -> DataFrame:
    rows = chunks.chunks(ix)
    return rows.select("symbol_id", F.length("text").alias("n_chars"), F.sha1("text").alias("text_hash"))


def substring_search(ix: Index) -> DataFrame:
    """Per query (folder name) the first twenty names that hold it: shorter ones first, then by name."""
    found = chunks.names_holding(ix.symbols, _name_queries(ix).select(F.col("query_id").alias("phrase")))
    return lookups.top(found, ["phrase"], [F.length("name"), "name"], 20).select(F.col("phrase").alias("query_id"), "rank", "name")


def ego_graph(ix: Index) -> DataFrame:
    """The edges among all symbols within two steps, either way, of a symbol of a changed file."""
    edges = ix.edges.where("src_symbol_id is not null and dst_symbol_id is not null")
    there = edges.select(F.col("src_symbol_id").alias("at"), F.col("dst_symbol_id").alias("to"))
    back = edges.select(F.col("dst_symbol_id").alias("at"), F.col("src_symbol_id").alias("to"))
    near = graph.walk(there.unionByName(back).distinct().withColumn("weight", F.lit(1.0)), changed_symbols(ix).withColumnRenamed("symbol_id", "node"), 2, Scratch(ix.spark, "ego"))
    ends = near.select("node")
    kept = edges.join(ends, F.col("src_symbol_id") == F.col("node"), "left_semi").join(ends, F.col("dst_symbol_id") == F.col("node"), "left_semi")
    return kept.select("src_symbol_id", "dst_symbol_id", "kind")


def packed_signatures(ix: Index) -> DataFrame:
    """Per file the signatures of its first eight symbols that fit 60 estimated tokens; those too long are skipped."""
    rows = ix.symbols.where("signature is not null").select("symbol_id", "file_id", retrieval.estimated_tokens(F.col("signature")).alias("cost"))
    return retrieval.greedy_pack(rows, "file_id", "symbol_id", "cost", 60)


def snippets(ix: Index) -> DataFrame:
    """The first three lines of every symbol with their numbers."""
    texts = ix.raw("sources", "path", "content").where("content is not null").dropDuplicates(["path"])
    lines = ix.files.select("file_id", "path").join(texts, "path").select("file_id", F.split(F.regexp_replace("content", "\r\n", "\n"), "\n").alias("lines"))
    rows = ix.symbols.where("start_line is not null").select("symbol_id", "file_id", "start_line").join(lines, "file_id")
    return rows.select("symbol_id", retrieval.snippet(F.col("lines"), F.col("start_line"), 3).alias("snippet"))


def vector_stats(ix: Index) -> DataFrame:
    rows = ix.raw("chunk_vectors").groupBy("chunk_id").agg(F.max(F.size("embedding")).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("n") >= 0).alias("n_embedded"), F.count_if(F.col("n") == 64).alias("n_sized"))


def largest(ix: Index) -> DataFrame:
    """The ten symbols most edges lead to and the ten files with most symbols."""
    into = ix.edges.where("dst_symbol_id is not null").groupBy(F.col("dst_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("symbol"))
    held = ix.symbols.where("file_id is not null").groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("file"))
    return lookups.top(into.unionByName(held), ["what"], [F.desc("n"), "id"], 10).select("what", "rank", "id", "n")


def name_lookup(ix: Index) -> DataFrame:
    """Every name and qualified name with its first ten symbols; a type stands for itself if the rest are its constructors or impls.

    Order: exported first, then path, line and id.
    """
    rows = ix.symbol_rows("symbol_id", "name", "qualified_name", "kind", "parent_symbol_id", "is_exported", "start_line")
    each = rows.select("*", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("look")).where("look is not null")
    order = [F.desc_nulls_last("is_exported"), "path", "start_line", "symbol_id"]
    first = lookups.top(each, ["look"], order, 10)
    kind = F.col("kind").isin([t for t in TYPES if t != "impl"])
    head = first.where(kind).groupBy("look").agg(F.min_by(F.struct("symbol_id", "path"), "rank").alias("t"))
    both = first.join(head, "look", "left")
    own = F.col("symbol_id") == F.col("t.symbol_id")
    part = ((F.col("kind") == "constructor") & (F.col("parent_symbol_id") == F.col("t.symbol_id"))) | ((F.col("kind") == "impl") & (F.col("path") == F.col("t.path")))
    whole = both.groupBy(F.col("look").alias("l")).agg(F.min(F.coalesce(own | part, F.lit(False)).cast("int")).alias("one"))
    kept = both.join(whole, F.col("look") == F.col("l")).where((F.col("one") == 0) | own)
    return kept.select("look", F.when(F.col("one") == 1, F.lit(1)).otherwise(F.col("rank")).alias("rank"), "symbol_id")


def exact_knn(ix: Index) -> DataFrame:
    """The ten nearest vectors of every twentieth chunk, all chunks compared."""
    rows = ix.raw("chunk_vectors", "chunk_id", "embedding").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
    near = retrieval.exact_nearest(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, 64)
    return near.withColumnRenamed("id", "chunk_id")


def call_paths(ix: Index) -> DataFrame:
    """The shortest call paths, of six steps at most, from the first symbol of each changed file to the twenty most called ones."""
    calls = ix.edges.where("kind = 'calls'")
    most = calls.where("dst_symbol_id is not null").groupBy(F.col("dst_symbol_id").alias("target_id")).agg(F.count(F.lit(1)).alias("n"))
    most = most.orderBy(F.desc("n"), "target_id").limit(20).select("target_id")
    first = ix.symbols.join(graph.changed_files(ix), "file_id", "left_semi").groupBy("file_id").agg(F.min("symbol_id").alias("source_id")).select("source_id")
    pairs = first.crossJoin(F.broadcast(most))  # twenty targets
    edges = calls.select(F.col("src_symbol_id").alias("at"), F.col("dst_symbol_id").alias("to"), F.col("confidence").alias("weight"))
    return graph.shortest_paths(edges, pairs, 6, Scratch(ix.spark, "paths"))


def visible_files(ix: Index) -> DataFrame:
    """How many files each C# file sees over namespaces."""
    return resolution.seen_without_import(ix).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_visible"))


def phrase_search(ix: Index) -> DataFrame:
    """Every dotted qualified name as a phrase: how many symbols' qualified names hold it, and the first and last of them."""
    texts = retrieval.distinct_texts(ix.symbols, "qualified_name")
    names = texts.where("qualified_name like '%.%'").select(F.col("qualified_name").alias("query_id"), retrieval.words(F.col("qualified_name")).alias("phrase"))
    return retrieval.phrase_counts(texts, names, "qualified_name")


QUERIES = {
    "reference_rows": _on_index(lookups.reference_rows),
    "neighbours": _on_index(lookups.neighbours),
    "occurrence_at": _on_index(lookups.occurrence_at),
    "call_sites": _on_index(lookups.call_sites),
    "batch_symbols": _on_index(removed_symbols),
    "removal_status": _on_index(lookups.removal_status),
    "removal_cascade": _on_index(lookups.removal_cascade),
    "resolution_pass": _on_index(scoped_resolution),
    "visible_files": _on_index(visible_files),
    "name_positions": _on_index(lookups.name_positions),
    "call_hierarchy": _on_index(caller_levels),
    "type_hierarchy": _on_index(subtype_levels),
    "chunk_builder": _on_index(chunk_digests),
    "near_copies": _on_index(chunks.near_copy_links),
    "substring_search": _on_index(substring_search),
    "phrase_search": _on_index(phrase_search),
    "ego_graph": _on_index(ego_graph),
    "call_paths": _on_index(call_paths),
    "greedy_pack": _on_index(packed_signatures),
    "snippets": _on_index(snippets),
    "vector_stats": _on_index(vector_stats),
    "largest": _on_index(largest),
    "name_lookup": _on_index(name_lookup),
    "exact_knn": _on_index(exact_knn),
}


def _levels(kinds: str, seeds: str, depth: int, k: int) -> str:
    """One common table a level; a symbol comes once below a root."""
    parts = [
        f"""shown AS (SELECT a, t FROM (SELECT e.a, e.t, row_number() OVER (PARTITION BY e.a ORDER BY e.c DESC NULLS LAST, s.name, e.t) AS rn
  FROM (SELECT dst_symbol_id AS a, src_symbol_id AS t, max(confidence) AS c FROM edg WHERE kind IN {kinds} AND dst_symbol_id IS NOT NULL GROUP BY 1, 2) e JOIN sym s ON s.symbol_id = e.t) WHERE rn <= {k})""",
        f"l0 AS (SELECT DISTINCT symbol_id AS root_id, 0 AS depth, NULL::BIGINT AS parent_id, symbol_id FROM ({seeds}))",
        "s0 AS (SELECT * FROM l0)",
    ]
    for d in range(1, depth + 1):
        parts.append(
            f"""l{d} AS (SELECT l.root_id, {d} AS depth, min(l.symbol_id) AS parent_id, h.t AS symbol_id FROM l{d - 1} l JOIN shown h ON h.a = l.symbol_id
  WHERE (l.root_id, h.t) NOT IN (SELECT (root_id, symbol_id) FROM s{d - 1}) GROUP BY 1, 4)"""
        )
        parts.append(f"s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM l{d})")
    return ",\n".join(parts) + f"\nSELECT root_id, depth, parent_id, symbol_id FROM s{depth} WHERE depth > 0"


_LINES = "lines AS (SELECT c.file_id, c.path, string_split(replace(s.content, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM cur c JOIN (SELECT DISTINCT path, content FROM sources WHERE content IS NOT NULL) s USING (path))"
_LEAVES, _HOLDERS = _in(chunks.LEAVES), _in(chunks.CONTAINERS)

ORACLES = {
    "reference_rows": _with(CUR, SYM, OCC)
    + """, o AS (SELECT occ_id, name, start_line, resolved_symbol_id, path FROM occ JOIN cur USING (file_id)),
hard AS (SELECT resolved_symbol_id AS symbol_id, path, start_line, occ_id, true AS is_resolved FROM o WHERE resolved_symbol_id IN (SELECT symbol_id FROM sym)),
loose AS (SELECT name, path, start_line, occ_id FROM o WHERE resolved_symbol_id IS NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, start_line, occ_id) <= 50),
both_ AS (SELECT * FROM hard UNION ALL SELECT s.symbol_id, l.path, l.start_line, l.occ_id, false FROM sym s JOIN loose l USING (name))
SELECT symbol_id, row_number() OVER (PARTITION BY symbol_id ORDER BY is_resolved DESC, path, start_line, occ_id)::INTEGER AS rank, occ_id, path, start_line, is_resolved FROM both_ QUALIFY rank <= 50""",
    "neighbours": _with(SYM, EDG)
    + f""", e AS (SELECT * FROM edg WHERE kind IN {_in(lookups.REACHED_BY)}),
n AS (SELECT src_symbol_id AS symbol_id, 'out' AS direction, dst_symbol_id AS other_id, kind, confidence FROM e UNION ALL SELECT dst_symbol_id, 'in', src_symbol_id, kind, confidence FROM e)
SELECT n.symbol_id, direction, row_number() OVER (PARTITION BY n.symbol_id, direction ORDER BY confidence DESC NULLS LAST, s.name, other_id, n.kind)::INTEGER AS rank, n.kind, other_id
FROM n JOIN sym s ON s.symbol_id = n.other_id WHERE n.symbol_id IS NOT NULL QUALIFY rank <= 25""",
    "occurrence_at": _with(SYM, OCC)
    + """SELECT s.symbol_id, arg_min(o.occ_id, {off: NOT (o.start_col <= s.start_col AND (o.end_line > o.start_line OR o.end_col > s.start_col)), d: abs(o.start_col - s.start_col), c: o.start_col, i: o.occ_id}) AS occ_id
FROM sym s JOIN occ o ON o.file_id = s.file_id AND o.start_line = s.start_line GROUP BY 1""",
    "call_sites": _with(SYM, OCC, EDG)
    + """SELECT e.src_symbol_id, e.dst_symbol_id, count(*) AS n_sites, min(o.start_line) AS first_line FROM edg e JOIN sym s ON s.symbol_id = e.src_symbol_id
JOIN occ o ON o.file_id = s.file_id AND o.resolved_symbol_id = e.dst_symbol_id AND o.role = 'call' AND o.start_line BETWEEN s.start_line AND s.end_line WHERE e.kind = 'calls' GROUP BY 1, 2""",
    "batch_symbols": _with(SYM)
    + "SELECT r.id AS place, r.id AS symbol_id, s.symbol_id IS NOT NULL AS found, name, kind FROM (SELECT DISTINCT rec_id AS id FROM removals WHERE rec_table = 'symbols' AND rec_id IS NOT NULL) r LEFT JOIN sym s ON s.symbol_id = r.id",
    "removal_status": _with(CUR, SYM)
    + """SELECT rec_table, count(*) FILTER (WHERE t.id IS NULL) AS n_gone, count(t.id) AS n_back FROM (SELECT DISTINCT rec_table, rec_id FROM removals WHERE rec_id IS NOT NULL) r
LEFT JOIN (SELECT 'files' AS t, file_id AS id FROM cur UNION ALL SELECT 'symbols', symbol_id FROM sym) t ON t.t = rec_table AND t.id = rec_id GROUP BY 1""",
    "removal_cascade": _with(CUR, SYM, IMP, OCC, EDG, CHG)
    + """, lost AS (SELECT symbol_id FROM sym WHERE file_id IN (SELECT file_id FROM chg))
SELECT 'files' AS table_name, count(*) AS n_rows, NULL::BIGINT AS n_resolved FROM cur WHERE file_id NOT IN (SELECT file_id FROM chg)
UNION ALL SELECT 'symbols', count(*), NULL FROM sym WHERE file_id NOT IN (SELECT file_id FROM chg)
UNION ALL SELECT 'imports', count(*), count(*) FILTER (WHERE resolved_file_id NOT IN (SELECT file_id FROM chg)) FROM imp WHERE file_id NOT IN (SELECT file_id FROM chg)
UNION ALL SELECT 'occurrences', count(*), count(*) FILTER (WHERE resolved_symbol_id NOT IN (SELECT symbol_id FROM lost)) FROM occ WHERE file_id NOT IN (SELECT file_id FROM chg)
UNION ALL SELECT 'edges', count(*), NULL FROM edg WHERE src_symbol_id NOT IN (SELECT symbol_id FROM lost) AND dst_symbol_id NOT IN (SELECT symbol_id FROM lost)""",
    "resolution_pass": _with(SYM, IMP, OCC, EDG, CHG, ENCLOSING)
    + """, scope AS (SELECT file_id FROM chg UNION SELECT i.file_id FROM imp i JOIN chg c ON c.file_id = i.resolved_file_id UNION SELECT file_id FROM occurrences WHERE name IN (SELECT name FROM symbols WHERE file_id IN (SELECT file_id FROM chg))),
own AS (SELECT symbol_id FROM sym WHERE file_id IN (SELECT file_id FROM scope)),
kept AS (SELECT * FROM edg WHERE provenance IS DISTINCT FROM 'index' OR src_symbol_id NOT IN (SELECT symbol_id FROM own)
  UNION ALL SELECT enclosing_symbol_id, resolved_symbol_id, 'calls', max(confidence), 'index' FROM enc WHERE enclosing_symbol_id <> resolved_symbol_id AND enclosing_symbol_id IN (SELECT symbol_id FROM own) GROUP BY 1, 2)
SELECT src_symbol_id, dst_symbol_id, kind, max(confidence) AS confidence, arg_max(provenance, {c: confidence, p: provenance}) AS provenance FROM kept GROUP BY 1, 2, 3""",
    "visible_files": _with(CUR, SYM, IMP, code_sql.VISIBLE) + "SELECT file_id, count(*) AS n_visible FROM visible GROUP BY 1",
    "name_positions": _with(CUR, SYM, _LINES)
    + """SELECT symbol_id, (start_line + place - 1)::INTEGER AS line FROM (SELECT symbol_id, start_line,
  list_min(list_filter(list_transform(list_slice(lines, start_line, start_line + 4), lambda x, i: CASE WHEN list_contains(regexp_split_to_array(x, '[^A-Za-z0-9_]+'), name) THEN i END), lambda i: i IS NOT NULL)) AS place
  FROM sym JOIN lines USING (file_id) WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') AND start_line > 0)""",
    "call_hierarchy": _with(SYM, EDG, CHG)[:-1] + ",\n" + _levels("('calls')", "SELECT symbol_id FROM sym WHERE file_id IN (SELECT file_id FROM chg)", 3, 25),
    "type_hierarchy": _with(SYM, EDG)[:-1] + ",\n" + _levels("('extends', 'implements')", "SELECT DISTINCT dst_symbol_id AS symbol_id FROM edg WHERE kind IN ('extends', 'implements') AND dst_symbol_id IS NOT NULL", 5, 50),
    "chunk_builder": _with(CUR, SYM, _LINES)
    + f""", mem AS (SELECT owner, string_agg(name, ', ' ORDER BY rn) AS names FROM (SELECT parent_symbol_id AS owner, name, row_number() OVER (PARTITION BY parent_symbol_id ORDER BY start_line, start_col, symbol_id) AS rn
  FROM sym WHERE parent_symbol_id IS NOT NULL AND name IS NOT NULL) WHERE rn <= 40 GROUP BY 1),
c AS (SELECT s.symbol_id, concat_ws(chr(10), f.path, kind || ' ' || coalesce(qualified_name, name), signature, substr(doc_comment, 1, 500),
    CASE WHEN kind IN {_HOLDERS} THEN 'members: ' || names ELSE substr(array_to_string(list_slice(lines, greatest(start_line, 1), greatest(start_line, 1) + greatest(end_line - start_line + 1, 0) - 1), chr(10)), 1, 1400) END) AS t
  FROM sym s JOIN cur f USING (file_id) LEFT JOIN lines l USING (file_id) LEFT JOIN mem ON owner = s.symbol_id WHERE kind IN {_LEAVES} OR kind IN {_HOLDERS})
SELECT symbol_id, length(t)::INTEGER AS n_chars, sha1(t) AS text_hash FROM c WHERE length(t) >= 24""",
    "near_copies": _with(CUR, SYM, _LINES)
    + r""", b AS (SELECT symbol_id AS id, list_filter(regexp_split_to_array(lower(array_to_string(list_slice(lines, start_line, end_line), chr(10))), '[^a-z0-9_]+'), lambda x: x <> '') AS w
  FROM sym JOIN lines USING (file_id) WHERE kind IN ('function', 'method', 'constructor') AND start_line >= 1 AND end_line >= start_line),
s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM b WHERE len(w) >= 5),
cls AS (SELECT min(id) AS class_id, s, count(*) AS n FROM s GROUP BY s),
g AS (SELECT class_id, len(s) AS size, unnest(s) AS g FROM cls),
shared AS (SELECT x.class_id AS a, y.class_id AS b, x.size AS na, y.size AS nb, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.class_id < y.class_id AND least(x.size, y.size) >= 0.8 * greatest(x.size, y.size) - 1e-9 GROUP BY 1, 2, 3, 4),
pairs AS (SELECT a, b FROM shared WHERE k / (na + nb - k) >= 0.8 - 1e-12),
ways AS (SELECT a AS class_id, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
across AS (SELECT w.class_id, sum(c.n) AS m FROM ways w JOIN cls c ON c.class_id = w.other GROUP BY 1)
SELECT s.id AS symbol_id, c.class_id, c.n AS n_copies, (coalesce(m, 0) + c.n - 1)::BIGINT AS n_links FROM s JOIN cls c USING (s) LEFT JOIN across USING (class_id)""",
    "substring_search": _with(CUR, SYM, code_sql.TERMS)
    + """, n AS (SELECT DISTINCT name FROM sym WHERE name IS NOT NULL), p AS (SELECT DISTINCT query_id FROM terms WHERE query_id <> '')
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY length(name), name)::INTEGER AS rank, name FROM p JOIN n ON contains(lower(name), lower(query_id)) QUALIFY rank <= 20""",
}
ORACLES |= {
    "ego_graph": _with(SYM, EDG, CHG, recursive=True)[:-1] + """,
e AS (SELECT src_symbol_id AS a, dst_symbol_id AS t FROM edg WHERE src_symbol_id <> dst_symbol_id UNION SELECT dst_symbol_id, src_symbol_id FROM edg WHERE src_symbol_id <> dst_symbol_id),
hop(node, depth) AS (SELECT symbol_id, 0 FROM sym WHERE file_id IN (SELECT file_id FROM chg) UNION SELECT e.t, hop.depth + 1 FROM hop JOIN e ON e.a = hop.node WHERE hop.depth < 2)
SELECT src_symbol_id, dst_symbol_id, kind FROM edg WHERE src_symbol_id IN (SELECT node FROM hop) AND dst_symbol_id IN (SELECT node FROM hop)""",
    "call_paths": _with(SYM, EDG, CHG, recursive=True)[:-1] + """,
src AS (SELECT min(symbol_id) AS s FROM sym WHERE file_id IN (SELECT file_id FROM chg) GROUP BY file_id),
tgt AS (SELECT dst_symbol_id AS t FROM edg WHERE kind = 'calls' AND dst_symbol_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
e AS (SELECT src_symbol_id AS a, dst_symbol_id AS t, confidence AS w FROM edg WHERE kind = 'calls' AND src_symbol_id <> dst_symbol_id),
hop(s, node, depth) AS (SELECT s, s, 0 FROM src UNION SELECT hop.s, e.t, hop.depth + 1 FROM hop JOIN e ON e.a = hop.node WHERE hop.depth < 6),
lev AS (SELECT s, node, min(depth) AS depth FROM hop GROUP BY 1, 2),
par AS (SELECT l.s, l.node, arg_max(e.a, {w: e.w, n: -e.a}) AS via FROM lev l JOIN e ON e.t = l.node JOIN lev p ON p.s = l.s AND p.node = e.a AND p.depth = l.depth - 1 GROUP BY 1, 2),
back(s, t, cur, path) AS (SELECT l.s, l.node, l.node, l.node::VARCHAR FROM lev l JOIN tgt ON tgt.t = l.node UNION ALL SELECT b.s, b.t, p.via, p.via || '>' || b.path FROM back b JOIN par p ON p.s = b.s AND p.node = b.cur)
SELECT b.s AS source_id, b.t AS target_id, l.depth AS steps, b.path FROM back b JOIN lev l ON l.s = b.s AND l.node = b.t WHERE b.cur = b.s""",
    "phrase_search": _with(SYM)[:-1] + r""",
q AS (SELECT DISTINCT qualified_name AS query_id, regexp_extract_all(lower(qualified_name), '[a-z0-9_$]+') AS p FROM sym WHERE qualified_name LIKE '%.%'),
d AS (SELECT symbol_id, regexp_extract_all(lower(coalesce(qualified_name, '')), '[a-z0-9_$]+') AS t FROM sym),
f AS (SELECT symbol_id, t, unnest(list_distinct(t)) AS w FROM d)
SELECT query_id, count(*) AS n_hits, min(symbol_id) AS first_id, max(symbol_id) AS last_id FROM q JOIN f ON f.w = q.p[1] AND len(p) > 1
WHERE len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 2] = p[1:len(p) - 1] AND starts_with(t[i + len(p) - 1], p[len(p)]))) > 0 GROUP BY 1""",
    "greedy_pack": _with(SYM, recursive=True)[:-1] + r""",
c AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY symbol_id) AS place, ceil(length(regexp_replace(signature, '\s+', ' ', 'g')) / 3.7)::BIGINT AS cost FROM sym WHERE signature IS NOT NULL QUALIFY place <= 8),
p(file_id, place, spent, kept) AS (SELECT DISTINCT file_id, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM c
  UNION ALL SELECT c.file_id, c.place, CASE WHEN spent + cost <= 60 THEN spent + cost ELSE spent END, CASE WHEN spent + cost <= 60 THEN list_append(kept, c.place::VARCHAR) ELSE kept END FROM p JOIN c ON c.file_id IS NOT DISTINCT FROM p.file_id AND c.place = p.place + 1)
SELECT file_id, array_to_string(arg_max(kept, place), ',') AS kept, arg_max(spent, place) AS spent FROM p GROUP BY 1""",
    "snippets": _with(CUR, SYM, _LINES)[:-1] + """
SELECT symbol_id, array_to_string(list_transform(list_slice(lines, greatest(start_line, 1), greatest(start_line, 1) + 2), lambda x, i: lpad((greatest(start_line, 1) + i - 1)::VARCHAR, 6, ' ') || '  ' || x), chr(10)) AS snippet
FROM sym JOIN lines USING (file_id) WHERE start_line IS NOT NULL""",
    "vector_stats": "SELECT count(*) AS n_chunks, count(n) AS n_embedded, count(*) FILTER (WHERE n = 64) AS n_sized FROM (SELECT chunk_id, max(len(embedding)) AS n FROM chunk_vectors GROUP BY 1)",
    "largest": _with(SYM, EDG)[:-1] + """
SELECT what, row_number() OVER (PARTITION BY what ORDER BY n DESC, id)::INTEGER AS rank, id, n FROM (SELECT 'symbol' AS what, dst_symbol_id AS id, count(*) AS n FROM edg WHERE dst_symbol_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'file', file_id, count(*) FROM sym WHERE file_id IS NOT NULL GROUP BY 2) QUALIFY rank <= 10""",
    "name_lookup": _with(CUR, SYM)[:-1] + f""",
r AS (SELECT s.*, path FROM sym s JOIN cur USING (file_id)),
l AS (SELECT name AS look, * FROM r WHERE name IS NOT NULL UNION ALL SELECT qualified_name, * FROM r WHERE qualified_name IS NOT NULL AND qualified_name IS DISTINCT FROM name),
f AS (SELECT *, row_number() OVER (PARTITION BY look ORDER BY is_exported DESC NULLS LAST, path, start_line, symbol_id)::INTEGER AS rank FROM l QUALIFY rank <= 10),
t AS (SELECT look, arg_min(symbol_id, rank) AS tid, arg_min(path, rank) AS tpath FROM f WHERE kind IN {_in([x for x in TYPES if x != 'impl'])} GROUP BY 1),
b AS (SELECT f.*, tid, coalesce(symbol_id = tid OR (kind = 'constructor' AND parent_symbol_id = tid) OR (kind = 'impl' AND path = tpath), false) AS own FROM f LEFT JOIN t USING (look)),
w AS (SELECT look, bool_and(own) AS one FROM b GROUP BY 1)
SELECT look, CASE WHEN one THEN 1 ELSE rank END AS rank, symbol_id FROM b JOIN w USING (look) WHERE NOT one OR symbol_id = tid""",
    "exact_knn": """WITH v AS (SELECT chunk_id AS id, list_transform(any_value(embedding), lambda e: e::DOUBLE) AS v FROM chunk_vectors
  WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND list_sum(list_transform(embedding, lambda e: e::DOUBLE * e)) > 0 GROUP BY 1),
c AS (SELECT a.id AS query_id, b.id AS chunk_id, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS x FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id)::INTEGER AS rank, chunk_id, round(x, 6) AS cosine FROM c QUALIFY rank <= 10""",
}
# a comma goes between the frames' common parts and those of a query
ORACLES = {name: sql.replace("\n, ", ",\n", 1) for name, sql in ORACLES.items()}

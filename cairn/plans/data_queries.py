"""The queries p2_, p3_ and p4_ over the given tables, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.frames import table
from cairn.operators import hierarchy, hotkeys, orphans


def _contract(spark: SparkSession, d: str) -> hierarchy.Contraction:
    rows = table(spark, d, "symbols", "symbol_id", "parent_symbol_id", "name")
    return hierarchy.contract(rows, "symbol_id", "parent_symbol_id", "name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_members(_contract(spark, d)).select(F.col("id").alias("symbol_id"), "cycle_id")


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.expand(_contract(spark, d)).select(
        F.col("id").alias("symbol_id"), "status", "root_id", "depth", F.when(F.col("status") == "tree", F.array_join("path_names", "/")).alias("path"), "cycle_id", "n_descendants"
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.expand(_contract(spark, d)))


# table, key, source of the problem's two tables with hot keys
HOT_TABLES = [("edges", "dst_symbol_id", "src_symbol_id"), ("occurrences", "name", "file_id")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The heavy keys by their figures; their rows alone make them heavy."""
    out = None
    for name, key, source in HOT_TABLES:
        heavy = hotkeys.heavy_figures(table(spark, d, name, key, source, "confidence"), key, source, "confidence", 0.02)
        part = heavy.select(F.lit(name).alias("src_table"), F.col("key").alias("heavy_key"))
        out = part if out is None else out.unionByName(part)
    return out


def _figures(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        hotkeys.key_figures(table(spark, d, name, key, source, "confidence"), key, source, "confidence").withColumn("src_table", F.lit(name))
        for name, key, source in HOT_TABLES
    ]
    return parts[0].unionByName(parts[1])


def p3_figures(spark: SparkSession, d: str) -> DataFrame:
    """The mean is rounded after a nudge, so that sums added in another order can't round a tie the other way."""
    return _figures(spark, d).select(
        "src_table", "key", "n_rows", "n_sources", F.round(F.col("mean_value") + 1e-9, 6).alias("mean_confidence"), "p25", "p50", "p75"
    )


def _orphan_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    columns = {
        "files": ["file_id", "path", "lang", "indexed_at", "is_test"],
        "symbols": ["symbol_id", "file_id", "parent_symbol_id"],
        "imports": ["import_id", "file_id", "specifier", "resolved_file_id"],
        "occurrences": ["occ_id", "file_id", "resolved_symbol_id"],
        "edges": ["src_symbol_id", "dst_symbol_id", "kind"],
        "assets": ["asset_id", "path", "indexed_at"],
        "asset_refs": ["ref_id", "asset_id", "target_kind", "target"],
        "removals": ["rec_table", "rec_id"],
    }
    return {name: table(spark, d, name, *cols) for name, cols in columns.items()}


P4_FIELDS = ["resolved_symbol_id", "resolved_file_id", "specifier", "target"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = orphans.orphan_cascade(_orphan_tables(spark, d))
    return rows.where((F.col("level") == 0) & F.col("field_name").isin(P4_FIELDS)).select(orphans.COLUMNS)


def p4_orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_cascade(_orphan_tables(spark, d))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(p4_orphans(spark, d))


QUERIES = {
    "p2_found": p2_found,
    "p2_hierarchy": p2_hierarchy,
    "p2_descendants": p2_descendants,
    "p3_found": p3_found,
    "p3_figures": p3_figures,
    "p4_found": p4_found,
    "p4_orphans": p4_orphans,
    "p4_counts": p4_counts,
}

_NODES = """nodes AS (
  SELECT s.symbol_id AS id, coalesce(s.name, '') AS name, p.symbol_id AS parent
  FROM (SELECT symbol_id, min(name) AS name, min(parent_symbol_id) AS parent_symbol_id FROM symbols
        WHERE symbol_id IS NOT NULL GROUP BY 1) s
  LEFT JOIN (SELECT DISTINCT symbol_id FROM symbols) p ON p.symbol_id = s.parent_symbol_id)"""

_UPWARDS = """up(id, cur) AS (
  SELECT id, parent FROM nodes WHERE parent IS NOT NULL
  UNION SELECT up.id, n.parent FROM up JOIN nodes n ON n.id = up.cur WHERE n.parent IS NOT NULL),
circles AS (
  SELECT id, (SELECT min(u.cur) FROM up u WHERE u.id = m.id) AS cycle_id
  FROM (SELECT id FROM up WHERE id = cur) m)"""

_TREES = """trees(id, root_id, depth, path, ids) AS (
  SELECT id, id, 0::BIGINT, name, [id] FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, t.root_id, t.depth + 1, t.path || '/' || n.name, list_append(t.ids, n.id)
  FROM trees t JOIN nodes n ON n.parent = t.id)"""

_P4_DIRECT = """cur AS (
  SELECT file_id, arg_max(path, indexed_at) AS path, arg_max(lang, indexed_at) AS lang,
         strftime(make_timestamp(min(indexed_at) * 1000), '%Y-%m-%d') AS d
  FROM files WHERE file_id IS NOT NULL GROUP BY 1),
sym AS (SELECT s.symbol_id, any_value(c.d) AS d FROM (SELECT symbol_id, min(file_id) AS file_id FROM symbols GROUP BY 1) s
        LEFT JOIN cur c ON c.file_id = s.file_id GROUP BY 1),
ast AS (SELECT asset_id, any_value(path) AS path, strftime(make_timestamp(max(indexed_at) * 1000), '%Y-%m-%d') AS d FROM assets GROUP BY 1),
occ AS (
  SELECT DISTINCT 'occurrences' AS src_table, 'resolved_symbol_id' AS field_name, o.occ_id AS row_id,
    CASE WHEN s.symbol_id IS NULL THEN CASE WHEN o.resolved_symbol_id IN (SELECT rec_id FROM removals WHERE rec_table = 'symbols')
         THEN 'deleted' ELSE 'missing' END WHEN s.d > f.d THEN 'late' END AS reason, f.d AS period_day
  FROM occurrences o LEFT JOIN sym s ON s.symbol_id = o.resolved_symbol_id LEFT JOIN cur f ON f.file_id = o.file_id
  WHERE o.resolved_symbol_id IS NOT NULL),
imp AS (
  SELECT DISTINCT 'imports' AS src_table, 'resolved_file_id' AS field_name, i.import_id AS row_id,
    CASE WHEN t.file_id IS NULL THEN CASE WHEN i.resolved_file_id IN (SELECT rec_id FROM removals WHERE rec_table = 'files')
         THEN 'deleted' ELSE 'missing' END WHEN t.d > f.d THEN 'late' END AS reason, f.d AS period_day
  FROM imports i LEFT JOIN cur t ON t.file_id = i.resolved_file_id LEFT JOIN cur f ON f.file_id = i.file_id
  WHERE i.resolved_file_id IS NOT NULL),
rel AS (
  SELECT DISTINCT i.import_id, f.d, regexp_replace(f.path, '/[^/]*$', '') || '/' || i.specifier AS raw
  FROM imports i JOIN cur f USING (file_id)
  WHERE f.lang IN ('typescript', 'javascript') AND i.resolved_file_id IS NULL AND starts_with(i.specifier, '.')),
fold AS (
  SELECT import_id, d, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(raw, '/'), lambda x: [x])),
    lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END) AS parts FROM rel),
base AS (SELECT import_id, d, array_to_string(parts, '/') AS b FROM fold),
cand AS (
  SELECT import_id, unnest(list_concat(
    [regexp_replace(regexp_replace(regexp_replace(b, '\\.(js|jsx)$', '.ts'), '\\.mjs$', '.mts'), '\\.cjs$', '.cts'),
     regexp_replace(b, '\\.(js|jsx)$', '.tsx'), b],
    list_transform(['.ts', '.tsx', '.d.ts', '.js', '.jsx', '.mjs', '.cjs', '.vue', '.svelte', '/index.ts', '/index.tsx',
                    '/index.js', '/index.jsx'], lambda x: b || x))) AS c FROM base),
spec AS (
  SELECT 'imports' AS src_table, 'specifier' AS field_name, import_id AS row_id, 'missing' AS reason, d AS period_day FROM base
  WHERE import_id NOT IN (SELECT c.import_id FROM cand c JOIN (SELECT DISTINCT path FROM files) f ON f.path = c.c)),
there AS (
  SELECT p, max(d) AS d FROM (SELECT path AS p, d FROM cur UNION ALL SELECT path, NULL FROM files UNION ALL SELECT path, NULL FROM assets)
  WHERE p IS NOT NULL GROUP BY 1),
ref AS (SELECT DISTINCT r.ref_id, r.target_kind, r.target, a.path, a.d FROM asset_refs r LEFT JOIN ast a USING (asset_id) WHERE r.target IS NOT NULL),
res AS (
  SELECT 'asset_refs' AS src_table, 'target' AS field_name, r.ref_id AS row_id,
    CASE WHEN t.p IS NULL THEN 'missing' WHEN t.d > r.d THEN 'late' END AS reason, r.d AS period_day
  FROM ref r LEFT JOIN there t ON t.p = string_split(r.path, '/')[1] || '/' || substr(r.target, 7) WHERE starts_with(r.target, 'res://')),
guid AS (
  SELECT 'asset_refs' AS src_table, 'target' AS field_name, ref_id AS row_id, 'missing' AS reason, d AS period_day FROM ref
  WHERE target_kind <> 'guid_of' AND regexp_full_match(target, '[0-9a-fA-F]{32}') AND NOT starts_with(target, '0000000000000000')
    AND lower(target) NOT IN (SELECT lower(target) FROM asset_refs WHERE target_kind = 'guid_of')),
direct AS (
  SELECT * FROM occ WHERE reason IS NOT NULL UNION ALL SELECT * FROM imp WHERE reason IS NOT NULL UNION ALL SELECT * FROM spec
  UNION ALL SELECT * FROM res WHERE reason IS NOT NULL UNION ALL SELECT * FROM guid)"""

_P4_ALL = """syms AS (
  SELECT s.symbol_id, s.file_id, s.parent, c.d, c.file_id IS NULL AS no_file
  FROM (SELECT symbol_id, min(file_id) AS file_id, min(parent_symbol_id) AS parent FROM symbols WHERE symbol_id IS NOT NULL GROUP BY 1) s
  LEFT JOIN cur c ON c.file_id = s.file_id),
gone AS (SELECT DISTINCT rec_table, rec_id FROM removals),
fallen AS (
  SELECT symbol_id, d, 'parent_symbol_id' AS field_name,
    CASE WHEN parent IN (SELECT rec_id FROM gone WHERE rec_table = 'symbols') THEN 'deleted' ELSE 'missing' END AS reason
  FROM syms WHERE parent IS NOT NULL AND parent NOT IN (SELECT symbol_id FROM syms)
  UNION ALL SELECT symbol_id, d, 'file_id',
    CASE WHEN file_id IN (SELECT rec_id FROM gone WHERE rec_table = 'files') THEN 'deleted' ELSE 'missing' END
  FROM syms WHERE file_id IS NOT NULL AND no_file),
down(symbol_id, d, reason, level) AS (
  SELECT symbol_id, any_value(d), min(reason), 0::BIGINT FROM fallen GROUP BY 1
  UNION ALL SELECT s.symbol_id, s.d, w.reason, w.level + 1 FROM down w JOIN syms s ON s.parent = w.symbol_id
  WHERE s.symbol_id NOT IN (SELECT symbol_id FROM fallen)),
heirs AS (
  SELECT DISTINCT 'occurrences' AS src_table, 'resolved_symbol_id' AS field_name, o.occ_id AS row_id, NULL::VARCHAR AS row_key,
    w.reason, f.d AS period_day, w.level + 1 AS level
  FROM occurrences o JOIN down w ON w.symbol_id = o.resolved_symbol_id LEFT JOIN cur f ON f.file_id = o.file_id),
links AS (
  SELECT DISTINCT e.src_symbol_id, e.dst_symbol_id, s.d,
    coalesce(e.src_symbol_id::VARCHAR, '') || '>' || coalesce(e.dst_symbol_id::VARCHAR, '') || ':' || coalesce(e.kind, '') AS row_key
  FROM edges e LEFT JOIN syms s ON s.symbol_id = e.src_symbol_id),
ends AS (
  SELECT 'src_symbol_id' AS field_name, src_symbol_id AS ref, d, row_key FROM links
  UNION ALL SELECT 'dst_symbol_id', dst_symbol_id, d, row_key FROM links),
owners AS (
  SELECT DISTINCT 'occurrences' AS src_table, 'file_id' AS field_name, occ_id AS row_id, NULL::VARCHAR AS row_key, 'files' AS rec_table, file_id AS ref, NULL::VARCHAR AS d
  FROM occurrences WHERE file_id NOT IN (SELECT file_id FROM cur)
  UNION SELECT 'imports', 'file_id', import_id, NULL, 'files', file_id, NULL FROM imports WHERE file_id NOT IN (SELECT file_id FROM cur)
  UNION SELECT 'asset_refs', 'asset_id', ref_id, NULL, 'assets', asset_id, NULL FROM asset_refs WHERE asset_id NOT IN (SELECT asset_id FROM assets)
  UNION SELECT 'edges', field_name, NULL, row_key, 'symbols', ref, d FROM ends WHERE ref IS NOT NULL AND ref NOT IN (SELECT symbol_id FROM syms)),
everything AS (
  SELECT src_table, field_name, row_id, NULL::VARCHAR AS row_key, reason, period_day, 0::BIGINT AS level FROM direct
  UNION ALL SELECT 'symbols', field_name, symbol_id, NULL, reason, d, 0 FROM fallen
  UNION ALL SELECT 'symbols', 'parent_symbol_id', symbol_id, NULL, reason, d, level FROM down WHERE level > 0
  UNION ALL SELECT * FROM heirs
  UNION ALL SELECT 'edges', field_name, NULL, row_key, w.reason, e.d, w.level + 1 FROM ends e JOIN down w ON w.symbol_id = e.ref
  UNION ALL SELECT src_table, field_name, row_id, row_key, CASE WHEN g.rec_id IS NULL THEN 'missing' ELSE 'deleted' END, d, 0
    FROM owners o LEFT JOIN gone g ON g.rec_table = o.rec_table AND g.rec_id = o.ref)"""

_P3_HALF = """SELECT '{t}' AS src_table, CAST({k} AS VARCHAR) AS key, count(*) AS n_rows, count(DISTINCT {s}) AS n_sources,
  round(avg(v) + 1e-9, 6) AS mean_confidence,
  max(v) FILTER (WHERE rn = greatest(ceil(0.25 * m), 1)) AS p25, max(v) FILTER (WHERE rn = greatest(ceil(0.5 * m), 1)) AS p50,
  max(v) FILTER (WHERE rn = greatest(ceil(0.75 * m), 1)) AS p75
FROM (SELECT *, row_number() OVER (PARTITION BY {k}, v IS NULL ORDER BY v) AS rn, count(v) OVER (PARTITION BY {k}) AS m
      FROM (SELECT {k}, {s}, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS v FROM {t} WHERE {k} IS NOT NULL))
GROUP BY {k}"""

ORACLES = {
    "p2_found": f"WITH RECURSIVE {_NODES}, {_UPWARDS} SELECT id AS symbol_id, cycle_id FROM circles",
    "p2_hierarchy": f"""WITH RECURSIVE {_NODES}, {_UPWARDS}, {_TREES},
chains(id, head, ids, cycle_id) AS (
  SELECT n.id, n.id, [n.id], c.cycle_id FROM nodes n JOIN circles c ON c.id = n.parent WHERE n.id NOT IN (SELECT id FROM circles)
  UNION ALL SELECT n.id, h.head, list_append(h.ids, n.id), h.cycle_id FROM chains h JOIN nodes n ON n.parent = h.id),
sizes AS (SELECT a, count(*) AS n FROM (SELECT unnest(ids[1:len(ids) - 1]) AS a FROM (SELECT ids FROM trees UNION ALL SELECT ids FROM chains)) GROUP BY 1)
SELECT id AS symbol_id, 'tree' AS status, root_id, depth, path, NULL::BIGINT AS cycle_id, coalesce(n, 0) AS n_descendants
FROM trees LEFT JOIN sizes ON a = id
UNION ALL SELECT id, 'below_cycle', NULL, NULL, NULL, cycle_id, coalesce(n, 0) FROM chains LEFT JOIN sizes ON a = id
UNION ALL SELECT id, 'cycle', NULL, NULL, NULL, cycle_id, NULL FROM circles""",
    "p2_descendants": f"""WITH RECURSIVE {_NODES}, {_UPWARDS}, {_TREES},
chains(id, ids) AS (
  SELECT n.id, [n.id] FROM nodes n JOIN circles c ON c.id = n.parent WHERE n.id NOT IN (SELECT id FROM circles)
  UNION ALL SELECT n.id, list_append(h.ids, n.id) FROM chains h JOIN nodes n ON n.parent = h.id)
SELECT ids[i] AS ancestor_id, id AS descendant_id, (len(ids) - i)::BIGINT AS distance
FROM (SELECT id, ids, unnest(range(1, len(ids))) AS i FROM (SELECT id, ids FROM trees UNION ALL SELECT id, ids FROM chains))""",
    "p3_found": """SELECT 'edges' AS src_table, CAST(dst_symbol_id AS VARCHAR) AS heavy_key FROM edges WHERE dst_symbol_id IS NOT NULL
GROUP BY dst_symbol_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)
UNION ALL SELECT 'occurrences', name FROM occurrences WHERE name IS NOT NULL
GROUP BY name HAVING count(*) >= 0.02 * (SELECT count(*) FROM occurrences)""",
    "p3_figures": _P3_HALF.format(t="edges", k="dst_symbol_id", s="src_symbol_id")
    + " UNION ALL "
    + _P3_HALF.format(t="occurrences", k="name", s="file_id"),
    "p4_found": f"WITH {_P4_DIRECT} SELECT * FROM direct",
    "p4_orphans": f"WITH RECURSIVE {_P4_DIRECT}, {_P4_ALL} SELECT * FROM everything",
    "p4_counts": f"""WITH RECURSIVE {_P4_DIRECT}, {_P4_ALL}
SELECT src_table, field_name, period_day, reason, count(*) FILTER (WHERE level = 0) AS n_direct, count(*) FILTER (WHERE level > 0) AS n_inherited
FROM everything GROUP BY ALL""",
}

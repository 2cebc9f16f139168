"""DuckDB's SQL for the code queries. The frames' common parts come first."""

from __future__ import annotations

from cairn.operators.relational import CALLABLE, DEAD_KINDS, TYPES
from cairn.operators.resolution import UBIQUITOUS

CUR = """cur AS (SELECT file_id, arg_max(path, indexed_at) AS path, arg_max(lang, indexed_at) AS lang, arg_max(is_test, indexed_at) AS is_test
  FROM files WHERE file_id IS NOT NULL GROUP BY 1)"""
SYM = "sym AS (SELECT DISTINCT ON (symbol_id) * FROM symbols)"
IMP = "imp AS (SELECT DISTINCT ON (import_id) * FROM imports)"
OCC = "occ AS (SELECT DISTINCT ON (occ_id) * FROM occurrences)"
EDG = "edg AS (SELECT src_symbol_id, dst_symbol_id, kind, max(confidence) AS confidence, arg_max(provenance, {c: confidence, p: provenance}) AS provenance FROM edges GROUP BY 1, 2, 3)"
AST = "ast AS (SELECT DISTINCT ON (asset_id) * FROM assets)"
REF = "ref AS (SELECT DISTINCT ON (ref_id) * FROM asset_refs)"
CHG = "chg AS (SELECT file_id FROM files WHERE file_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT indexed_at) > 1)"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


DIR = "CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '' END"
BASE = "regexp_extract({p}, '([^/]*)$', 1)"

PAIRS = f"""pairs AS (SELECT DISTINCT i.file_id, i.resolved_file_id, a.path AS from_path, b.path AS to_path
  FROM imports i JOIN cur a ON a.file_id = i.file_id JOIN cur b ON b.file_id = i.resolved_file_id)"""
DEAD = f"""dead AS (SELECT s.symbol_id, s.name, s.kind, f.path, f.lang, f.is_test, s.is_exported, s.start_line FROM sym s JOIN cur f USING (file_id)
  WHERE s.kind IN {_in(DEAD_KINDS)}
    AND NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.resolved_symbol_id = s.symbol_id)
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst_symbol_id = s.symbol_id)
    AND NOT EXISTS (SELECT 1 FROM sym p WHERE p.symbol_id = s.parent_symbol_id AND p.kind IN ('function', 'method', 'constructor')))"""
ENCLOSING = """inside AS (SELECT o.occ_id, o.resolved_symbol_id, o.confidence, s.symbol_id AS enclosing_symbol_id,
    row_number() OVER (PARTITION BY o.occ_id ORDER BY s.start_line DESC, s.start_col DESC, s.end_line, s.end_col, s.symbol_id) AS rn
  FROM occ o JOIN sym s ON s.file_id = o.file_id AND (s.start_line, s.start_col) <= (o.start_line, o.start_col) AND (o.start_line, o.start_col) <= (s.end_line, s.end_col)
  WHERE o.role = 'call' AND o.resolved_symbol_id IS NOT NULL),
enc AS (SELECT occ_id, resolved_symbol_id, confidence, enclosing_symbol_id FROM inside WHERE rn = 1)"""

VISIBLE = r"""spaced AS (SELECT DISTINCT file_id, string_split(path, '/')[1] AS root, coalesce(qualified_name, name) AS space FROM sym JOIN cur USING (file_id) WHERE kind = 'namespace' AND lang = 'c_sharp'),
shows AS (SELECT root, space FROM spaced GROUP BY 1, 2 HAVING count(*) <= 50),
looks AS (SELECT file_id, root, space FROM spaced UNION SELECT i.file_id, string_split(f.path, '/')[1], regexp_replace(regexp_replace(specifier, '^static\s+', ''), '^\w+\s*=\s*', '') FROM imp i JOIN cur f USING (file_id) WHERE f.lang = 'c_sharp' AND specifier IS NOT NULL),
visible AS (SELECT DISTINCT a.file_id, b.file_id AS t FROM looks a JOIN shows USING (root, space) JOIN spaced b USING (root, space) WHERE a.file_id <> b.file_id)"""

_COMMON = ", ".join("('%s', '%s')" % (lang, n.replace("'", "''")) for lang, names in UBIQUITOUS.items() for n in names)
_CALL = _in(CALLABLE)
NAMES = f"""common(lang, name) AS (VALUES {_COMMON}),
uses AS (SELECT DISTINCT file_id, name, role = 'call' AS is_call FROM occurrences WHERE name IS NOT NULL AND file_id IS NOT NULL),
bound AS (SELECT file_id, name, arg_max(resolved_file_id, import_id) AS target FROM
  (SELECT import_id, file_id, resolved_file_id, unnest(names) AS name FROM imp WHERE resolved_file_id IS NOT NULL) WHERE name <> '*' GROUP BY 1, 2),
cand AS (
  SELECT u.file_id, u.name, u.is_call, 1 AS tier, s.symbol_id, s.kind FROM uses u JOIN bound b USING (file_id, name) JOIN sym s ON s.file_id = b.target AND s.name = u.name AND s.is_exported
  UNION ALL SELECT u.file_id, u.name, u.is_call, 2, s.symbol_id, s.kind FROM uses u JOIN sym s USING (file_id, name)
  UNION ALL SELECT u.file_id, u.name, u.is_call, 3, s.symbol_id, s.kind FROM rest u JOIN (SELECT file_id, resolved_file_id AS t FROM imp WHERE resolved_file_id IS NOT NULL UNION SELECT file_id, t FROM visible) i USING (file_id)
    JOIN sym s ON s.file_id = i.t AND s.name = u.name AND s.is_exported),
rest AS (SELECT u.* FROM uses u JOIN cur f USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.lang = f.lang AND c.name = u.name)),
per AS (SELECT file_id, name, is_call, tier, count(*) AS n, count(*) FILTER (WHERE kind IN {_CALL}) AS nc, min(symbol_id) AS low, min(symbol_id) FILTER (WHERE kind IN {_CALL}) AS lowc FROM cand GROUP BY 1, 2, 3, 4),
anywhere AS (SELECT name, count(*) AS n, count(*) FILTER (WHERE kind IN {_CALL}) AS nc, min(symbol_id) AS low, min(symbol_id) FILTER (WHERE kind IN {_CALL}) AS lowc FROM sym WHERE is_exported AND name IS NOT NULL GROUP BY 1),
tiers AS (SELECT * FROM per UNION ALL SELECT u.file_id, u.name, u.is_call, 4, g.n, g.nc, g.low, g.lowc FROM rest u JOIN anywhere g USING (name)),
pref AS (SELECT file_id, name, is_call, tier, CASE WHEN is_call AND nc > 0 THEN nc ELSE n END AS n, CASE WHEN is_call AND nc > 0 THEN lowc ELSE low END AS symbol_id FROM tiers),
named AS (SELECT file_id, name, is_call, symbol_id,
    CASE tier WHEN 1 THEN 0.9 WHEN 2 THEN CASE WHEN n = 1 THEN 0.85 ELSE 0.7 END WHEN 3 THEN CASE WHEN n = 1 THEN 0.7 ELSE 0.5 END ELSE CASE WHEN n = 1 THEN 0.6 ELSE 0.35 END END::DOUBLE AS confidence, tier
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name, is_call ORDER BY tier) AS rn FROM pref WHERE tier < 4 OR n <= 4) WHERE rn = 1)"""
NAMES = NAMES.replace("cand AS (", "@cand AS (").replace("rest AS (SELECT", "@rest AS (SELECT")
_head, _cand, _rest = NAMES.split("@")
NAMES = _head + _rest.split("),\nper AS")[0] + "),\n" + _cand + "per AS" + _rest.split("),\nper AS")[1]

_TYPES = _in(TYPES)
BASES = f"""common(lang, name) AS (VALUES {_COMMON}),
bound AS (SELECT file_id, name, arg_max(resolved_file_id, import_id) AS target FROM
  (SELECT import_id, file_id, resolved_file_id, unnest(names) AS name FROM imp WHERE resolved_file_id IS NOT NULL) WHERE name <> '*' GROUP BY 1, 2),
wants AS (SELECT DISTINCT symbol_id, file_id, b.name AS base_name, b.kind AS base_kind FROM (SELECT symbol_id, file_id, unnest(bases) AS b FROM sym WHERE bases IS NOT NULL) WHERE b.name IS NOT NULL),
forms AS (SELECT *, 0 AS form, base_name AS look FROM wants UNION ALL
  SELECT *, 1, regexp_extract(base_name, '([^.:]*)$', 1) FROM wants WHERE regexp_extract(base_name, '([^.:]*)$', 1) <> base_name),
types AS (SELECT symbol_id AS tid, file_id AS tfile, name AS look, is_exported FROM sym WHERE kind IN {_TYPES}),
found AS (
  SELECT w.*, 1 AS tier, tid, 0.9 AS confidence FROM forms w JOIN types t ON t.look = w.look AND t.tfile = w.file_id WHERE tid <> symbol_id
  UNION ALL SELECT w.*, 2, tid, 0.9 FROM forms w JOIN bound b ON b.file_id = w.file_id AND b.name = w.look JOIN types t ON t.look = w.look AND t.tfile = b.target AND t.is_exported WHERE tid <> symbol_id
  UNION ALL SELECT w.*, 3, tid, 0.85 FROM forms w JOIN (SELECT DISTINCT file_id, resolved_file_id AS t FROM imp WHERE resolved_file_id IS NOT NULL) i USING (file_id) JOIN types t ON t.look = w.look AND t.tfile = i.t AND t.is_exported WHERE tid <> symbol_id
  UNION ALL SELECT w.*, 4, g.tid, CASE WHEN g.n = 1 THEN 0.7 ELSE 0.4 END FROM (SELECT w.* FROM forms w JOIN cur f USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.lang = f.lang AND c.name = w.look)) w JOIN (SELECT look, count(*) AS n, min(tid) AS tid FROM types WHERE is_exported GROUP BY 1 HAVING count(*) <= 4) g USING (look) WHERE g.tid <> symbol_id),
based AS (SELECT symbol_id, base_name, base_kind, tid AS base_symbol_id, confidence::DOUBLE AS confidence FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol_id, base_name, base_kind ORDER BY form, tier, tid) AS rn FROM found) WHERE rn = 1)"""


def _walk(edges: str, seeds: str, depth: int) -> str:
    return f"""e AS ({edges}), hop(node, depth) AS (SELECT DISTINCT node, 0 FROM ({seeds}) WHERE node IS NOT NULL UNION SELECT e.t, hop.depth + 1 FROM hop JOIN e ON e.a = hop.node WHERE hop.depth < {depth}),
lev AS (SELECT node, min(depth) AS depth FROM hop GROUP BY 1),
walked AS (SELECT l.node, l.depth, (SELECT arg_max(e.a, {{w: e.w, n: -e.a}}) FROM e JOIN lev p ON p.node = e.a WHERE e.t = l.node AND p.depth = l.depth - 1) AS via FROM lev l)"""


IMPACT = _walk(
    "SELECT dst_symbol_id AS a, src_symbol_id AS t, max(confidence) AS w FROM edg WHERE kind IN ('calls', 'extends', 'implements', 'overrides') AND confidence >= 0.5 AND dst_symbol_id <> src_symbol_id GROUP BY 1, 2",
    "SELECT symbol_id AS node FROM sym JOIN chg USING (file_id)", 6,
)
REACH = _walk("SELECT DISTINCT resolved_file_id AS a, file_id AS t, 1.0 AS w FROM imp WHERE resolved_file_id <> file_id", "SELECT file_id AS node FROM chg", 4)
_FILES_HIT = f"""iw AS (SELECT s.file_id, min(i.depth) AS call_depth FROM impacted i JOIN sym s ON s.symbol_id = i.node WHERE i.depth > 0 GROUP BY 1),
hit AS (SELECT coalesce(iw.file_id, r.node) AS file_id, coalesce(call_depth, r.depth) AS depth, CASE WHEN call_depth IS NOT NULL THEN 'calls' ELSE 'imports' END AS layer
  FROM iw FULL JOIN (SELECT * FROM reached WHERE depth > 0) r ON r.node = iw.file_id),
touched AS (SELECT file_id, path, is_test, depth, layer FROM hit JOIN cur USING (file_id) WHERE file_id NOT IN (SELECT file_id FROM chg))"""
_TWO = (
    IMPACT.replace("e AS (", "e1 AS (", 1).replace("hop(", "hop1(").replace("FROM hop ", "FROM hop1 ").replace("hop.", "hop1.").replace("JOIN e ON e.a", "JOIN e1 e ON e.a").replace("FROM e JOIN", "FROM e1 e JOIN").replace("lev AS", "lev1 AS").replace("JOIN lev p", "JOIN lev1 p").replace("FROM lev l", "FROM lev1 l").replace("walked AS", "impacted AS")
    + ",\n" + REACH.replace("e AS (", "e2 AS (", 1).replace("hop(", "hop2(").replace("FROM hop ", "FROM hop2 ").replace("hop.", "hop2.").replace("JOIN e ON e.a", "JOIN e2 e ON e.a").replace("FROM e JOIN", "FROM e2 e JOIN").replace("lev AS", "lev2 AS").replace("JOIN lev p", "JOIN lev2 p").replace("FROM lev l", "FROM lev2 l").replace("walked AS", "reached AS")
)

TERMS = r"""q AS (SELECT DISTINCT regexp_replace(unnest(string_split(path, '/')[2:]), '\.[^.]*$', '') AS query_id FROM cur),
qt AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(query_id, '([a-z])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')) AS terms FROM q),
terms AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n_terms FROM qt WHERE len(terms) > 0),
docs AS (SELECT symbol_id, regexp_extract_all(lower(coalesce(name, '')), '[a-z0-9_$]+') AS a, regexp_extract_all(lower(coalesce(qualified_name, '')), '[a-z0-9_$]+') AS b, regexp_extract_all(lower(coalesce(doc_comment, '')), '[a-z0-9_$]+') AS c FROM sym),
post AS (SELECT term, symbol_id, sum(w) AS f FROM (SELECT symbol_id, unnest(a) AS term, 10.0 AS w FROM docs UNION ALL SELECT symbol_id, unnest(b), 5.0 FROM docs UNION ALL SELECT symbol_id, unnest(c), 1.0 FROM docs) GROUP BY 1, 2)"""
BM25 = TERMS + r""",
sizes AS (SELECT symbol_id, len(a) + len(b) + len(c) AS d FROM docs),
corpus AS (SELECT count(*) AS n_docs, avg(d) AS mean_d FROM sizes),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
gains AS (SELECT query_id, symbol_id, n_terms, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean_d))), 9) AS score, count(*) AS n
  FROM terms JOIN post USING (term) JOIN df USING (term) JOIN sizes USING (symbol_id), corpus GROUP BY 1, 2, 3),
ranked AS (SELECT query_id, symbol_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS rank FROM gains WHERE n = n_terms)"""

_SCRIPT_SUFFIXES = "['.ts', '.tsx', '.d.ts', '.js', '.jsx', '.mjs', '.cjs', '.vue', '.svelte', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']"


def _norm(x: str) -> str:
    return (
        f"array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({x}, '/'), lambda q: [q])), "
        "lambda a, q: CASE WHEN q[1] IN ('', '.') THEN a WHEN q[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, q) END), '/')"
    )


def _join(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' THEN {b} ELSE {a} || '/' || {b} END"


_ROOTED = "CASE WHEN contains(spec, '/') AND NOT starts_with(spec, '.') THEN [root || '/' || spec || '{end}'] ELSE []::VARCHAR[] END"
_PREFIXES = "flatten(list_transform(range(len(segs), 0, -1), lambda k: [{b} || '/' || array_to_string(segs[1:k], '/') || '.rs', {b} || '/' || array_to_string(segs[1:k], '/') || '/mod.rs']))"
_RELATIVE = _norm("CASE WHEN dots > 1 THEN (" + _join("here", "rtrim(repeat('../', dots - 1), '/')") + ") ELSE (" + _join("here", "'.'") + ") END || '/' || rest")
IMPORTS = f"""src AS (SELECT i.import_id, i.specifier AS spec, f.lang, f.path, {DIR.format(p='f.path')} AS here, string_split(f.path, '/')[1] AS root,
    length(regexp_extract(i.specifier, '^(\\.*)', 1)) AS dots, replace(regexp_replace(i.specifier, '^\\.+', ''), '.', '/') AS rest,
    string_split(regexp_replace(i.specifier, '^(crate|self|super)::', ''), '::') AS segs
  FROM imp i JOIN cur f USING (file_id) WHERE i.specifier IS NOT NULL),
near_ AS (SELECT *, {_norm("(" + _join("here", "spec") + ")")} AS near FROM src),
near2 AS (SELECT *, regexp_replace(near, '\\.(js|mjs|cjs|jsx)$', '') AS stem, regexp_extract(near, '\\.(js|mjs|cjs|jsx)$', 1) AS ending,
    CASE WHEN dots > 0 THEN [{_RELATIVE}] ELSE [{_join("root", "rest")}, {_join("here", "rest")}] END AS pybases,
    {DIR.format(p='here')} AS above FROM near_),
lists AS (SELECT import_id, CASE
    WHEN lang IN ('typescript', 'javascript') THEN CASE WHEN starts_with(spec, '.') THEN list_concat(
      [CASE ending WHEN 'mjs' THEN stem || '.mts' WHEN 'cjs' THEN stem || '.cts' WHEN '' THEN NULL ELSE stem || '.ts' END, CASE WHEN ending IN ('js', 'jsx') THEN stem || '.tsx' END, near],
      list_transform({_SCRIPT_SUFFIXES}, lambda q: near || q)) END
    WHEN lang = 'python' THEN flatten(list_transform(pybases, lambda b: [b || '.py', b || '/__init__.py', b || '.pyi']))
    WHEN lang = 'ruby' THEN CASE WHEN starts_with(spec, '.') THEN [near, near || '.rb'] ELSE [root || '/lib/' || spec || '.rb', root || '/' || spec || '.rb'] END
    WHEN lang = 'gdscript' THEN list_concat(CASE WHEN starts_with(spec, 'res://') THEN [root || '/' || substr(spec, 7)] WHEN starts_with(spec, '.') THEN [near] ELSE []::VARCHAR[] END, {_ROOTED.format(end='.gd')})
    WHEN lang = 'go' THEN {_ROOTED.format(end='.go')}
    WHEN lang = 'c_sharp' THEN {_ROOTED.format(end='.cs')}
    WHEN lang = 'java' THEN {_ROOTED.format(end='.java')}
    WHEN lang = 'cpp' THEN CASE WHEN NOT starts_with(spec, '<') THEN [near, {_join("root", "spec")}] END
    WHEN lang = 'rust' THEN CASE WHEN starts_with(spec, './') THEN [near || '.rs', near || '/mod.rs', root || '/src/' || substr(spec, 3) || '.rs', root || '/src/' || substr(spec, 3) || '/mod.rs']
      ELSE list_concat(CASE WHEN starts_with(spec, 'crate::') THEN list_concat({_PREFIXES.format(b="root || '/src'")}, {_PREFIXES.format(b='root')})
        WHEN starts_with(spec, 'self::') THEN {_PREFIXES.format(b='here')} WHEN starts_with(spec, 'super::') THEN {_PREFIXES.format(b='above')} ELSE []::VARCHAR[] END, {_ROOTED.format(end='.rs')}) END
  END AS l FROM near2),
listed AS (SELECT import_id, unnest(l) AS c, generate_subscripts(l, 1) AS rank FROM lists),
by_path AS (SELECT path AS c, min(file_id) AS target FROM cur GROUP BY 1),
ruled AS (SELECT import_id, arg_min(target, rank) AS target_file_id FROM listed JOIN by_path USING (c) GROUP BY 1),
ends AS (SELECT file_id, array_to_string(string_split(path, '/')[i:], '/') AS suffix FROM (SELECT file_id, path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM cur WHERE lang = 'java')),
sole AS (SELECT suffix, min(file_id) AS target_file_id FROM ends GROUP BY 1 HAVING count(*) = 1),
java AS (SELECT import_id, target_file_id FROM src JOIN sole ON suffix = replace(regexp_replace(spec, '\\.\\*$', ''), '.', '/') || '.java' WHERE lang = 'java'),
folders AS (SELECT {DIR.format(p='path')} AS folder, arg_min(file_id, {{p: path, f: file_id}}) AS target_file_id FROM cur WHERE ends_with(path, '.go') GROUP BY 1),
go AS (SELECT import_id, target_file_id FROM (SELECT import_id, CASE WHEN spec = root OR starts_with(spec, root || '/') THEN spec ELSE root || '/' || spec END AS folder FROM src
  WHERE lang = 'go' AND (spec = root OR contains(spec, '/'))) JOIN folders USING (folder)),
spaces AS (SELECT root, space, arg_min(file_id, {{p: path, f: file_id}}) AS target_file_id FROM (SELECT string_split(f.path, '/')[1] AS root, coalesce(s.qualified_name, s.name) AS space, f.file_id, f.path
  FROM sym s JOIN cur f USING (file_id) WHERE s.kind = 'namespace' AND f.lang = 'c_sharp') GROUP BY 1, 2),
sharp AS (SELECT import_id, target_file_id FROM src JOIN spaces p ON p.root = src.root AND p.space = regexp_replace(regexp_replace(spec, '^static\\s+', ''), '^\\w+\\s*=\\s*', '') WHERE lang = 'c_sharp'),
bases AS (SELECT string_split(path, '/')[1] AS root, {BASE.format(p='path')} AS base, min(file_id) AS target_file_id FROM cur GROUP BY 1, 2 HAVING count(DISTINCT file_id) = 1),
cpp AS (SELECT import_id, target_file_id FROM src JOIN bases b ON b.root = src.root AND b.base = {BASE.format(p='spec')} WHERE lang = 'cpp' AND NOT starts_with(spec, '<')),
rest_ AS (SELECT import_id, any_value(target_file_id) AS target_file_id FROM (SELECT * FROM java UNION ALL SELECT * FROM go UNION ALL SELECT * FROM sharp UNION ALL SELECT * FROM cpp) WHERE import_id NOT IN (SELECT import_id FROM ruled) GROUP BY 1)"""

ORACLES = {
    "counts_by_language": _with(CUR, SYM) + "SELECT lang, count(DISTINCT file_id) AS n_files, count(s.symbol_id) AS n_symbols FROM cur LEFT JOIN sym s USING (file_id) GROUP BY 1",
    "index_stats": _with(CUR, SYM, IMP, OCC, EDG)
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n FROM {t}" for m, t in (("files", "cur"), ("symbols", "sym"), ("imports", "imp"), ("occurrences", "occ"), ("edges", "edg"))),
    "resolve_stats": _with(CUR, OCC) + "SELECT lang, role, count(*) AS n, count(resolved_symbol_id) AS n_resolved, round(100 * (1 - count(resolved_symbol_id) / count(*)), 4) AS pct_unresolved FROM occ JOIN cur USING (file_id) GROUP BY 1, 2",
    "name_occurrence_counts": _with(OCC) + "SELECT name, count(*) AS n, count(*) FILTER (WHERE resolved_symbol_id IS NULL) AS n_unresolved FROM occ GROUP BY 1",
    "namespace_members": _with(CUR, SYM) + "SELECT qualified_name, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM sym JOIN cur USING (file_id) WHERE kind = 'namespace' GROUP BY 1",
    "symbols_exact_name": _with(CUR, SYM)
    + "SELECT * FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY is_exported DESC NULLS LAST, path, start_line, symbol_id)::INTEGER AS place, symbol_id, path, start_line FROM sym JOIN cur USING (file_id)) WHERE place <= 10",
    "keyset_page": _with(EDG) + "SELECT src_symbol_id, dst_symbol_id, confidence FROM edg WHERE kind = 'calls' AND provenance = 'index' AND confidence <= 0.6 AND (src_symbol_id, dst_symbol_id) > (0, 0) ORDER BY 1, 2 LIMIT 200",
    "dependencies": _with(CUR, IMP) + "SELECT import_id, a.path AS from_path, specifier, b.path AS to_path FROM imp i JOIN cur a ON a.file_id = i.file_id LEFT JOIN cur b ON b.file_id = i.resolved_file_id",
    "import_pairs": _with(CUR, PAIRS) + "SELECT * FROM pairs",
    "import_dir_weights": _with(CUR, PAIRS) + f"SELECT from_dir, to_dir, count(*) AS weight FROM (SELECT {DIR.format(p='from_path')} AS from_dir, {DIR.format(p='to_path')} AS to_dir FROM pairs) WHERE from_dir <> to_dir GROUP BY 1, 2",
    "dead_candidates": _with(CUR, SYM, DEAD) + "SELECT * FROM dead",
    "internal_only_exports": _with(SYM)
    + """, uses AS (SELECT DISTINCT resolved_symbol_id AS sid, file_id AS u FROM occurrences WHERE resolved_symbol_id IS NOT NULL UNION SELECT e.dst_symbol_id, s.file_id FROM edges e JOIN sym s ON s.symbol_id = e.src_symbol_id)
SELECT symbol_id, name, kind, file_id FROM sym s WHERE is_exported AND EXISTS (SELECT 1 FROM uses WHERE sid = s.symbol_id AND u = s.file_id) AND NOT EXISTS (SELECT 1 FROM uses WHERE sid = s.symbol_id AND u <> s.file_id)""".replace(", uses", ",\nuses", 1),
    "find_references": _with(SYM, OCC)
    + """SELECT s.symbol_id, coalesce(h.n, 0) AS n_resolved, coalesce(l.n, 0) - coalesce(w.n, 0) AS n_possible FROM sym s
LEFT JOIN (SELECT resolved_symbol_id AS k, count(*) AS n FROM occ WHERE resolved_symbol_id IS NOT NULL GROUP BY 1) h ON h.k = s.symbol_id
LEFT JOIN (SELECT name, count(*) AS n FROM occ WHERE resolved_symbol_id IS NULL GROUP BY 1) l ON l.name = s.name
LEFT JOIN (SELECT file_id, name, count(*) AS n FROM occ WHERE resolved_symbol_id IS NULL GROUP BY 1, 2) w ON w.file_id = s.file_id AND w.name = s.name""",
    "file_line_counts": "SELECT file_id, max(end_line) AS n_lines FROM symbols GROUP BY 1",
    "enclosing_symbols": _with(OCC, SYM, ENCLOSING) + "SELECT * FROM enc",
    "edge_upsert": _with(EDG) + "SELECT * FROM edg",
    "hash_skip": """SELECT DISTINCT c.file_id, c.path FROM (SELECT file_id, path, hash FROM files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC) = 1) c
JOIN sources s USING (path) WHERE s.content IS NOT NULL AND c.file_id IS NOT NULL AND c.hash IS DISTINCT FROM sha1(s.content)""",
    "vector_reuse": """WITH v AS (SELECT chunk_id, min(embedding) AS e FROM chunk_vectors WHERE embedding IS NOT NULL GROUP BY 1), f AS (SELECT e, min(chunk_id) AS r FROM v GROUP BY 1 HAVING count(*) > 1)
SELECT chunk_id, r AS reused_chunk_id FROM v JOIN f USING (e) WHERE chunk_id <> r""",
    "asset_stats": _with(AST) + "SELECT engine, kind, count(*) AS n FROM ast GROUP BY 1, 2",
    "guid_references": _with(AST, REF)
    + r""", owners AS (SELECT target, min(regexp_replace(path, '\.meta$', '')) AS owner_path FROM ref JOIN ast USING (asset_id) WHERE target_kind = 'guid_of' AND target IS NOT NULL GROUP BY 1)
SELECT ref_id, r.target, a.path AS user_path, owner_path FROM ref r JOIN ast a USING (asset_id) LEFT JOIN owners o ON o.target = r.target WHERE target_kind IN ('script', 'prefab', 'asset') AND NOT starts_with(r.target, 'res://')""",
    "debounce_sessions": """WITH e AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM b GROUP BY user_id, batch""",
    "resolve_imports": _with(CUR, SYM, IMP, IMPORTS) + "SELECT * FROM ruled UNION ALL SELECT * FROM rest_",
    "resolve_names": _with(CUR, SYM, IMP, VISIBLE, NAMES) + "SELECT * FROM named",
    "resolve_occurrences": _with(CUR, SYM, IMP, OCC, VISIBLE, NAMES) + "SELECT occ_id, n.symbol_id, n.confidence FROM occ o JOIN named n ON n.file_id = o.file_id AND n.name = o.name AND n.is_call = (o.role = 'call')",
    "resolve_bases": _with(CUR, SYM, IMP, BASES) + "SELECT * FROM based",
    "call_edges": _with(OCC, SYM, ENCLOSING) + "SELECT enclosing_symbol_id AS src_symbol_id, resolved_symbol_id AS dst_symbol_id, 'calls' AS kind, max(confidence) AS confidence, 'index' AS provenance FROM enc WHERE enclosing_symbol_id <> resolved_symbol_id GROUP BY 1, 2",
    "type_edges": _with(CUR, SYM, IMP, BASES) + "SELECT symbol_id AS src_symbol_id, base_symbol_id AS dst_symbol_id, base_kind AS kind, max(confidence) AS confidence, 'index' AS provenance FROM based GROUP BY 1, 2, 3",
    "promote_edges": _with(SYM, OCC, EDG)
    + """, low AS (SELECT * FROM edg WHERE kind = 'calls' AND provenance = 'index' AND confidence <= 0.6),
sites AS (SELECT e.src_symbol_id, e.dst_symbol_id, s.file_id, min({l: o.start_line, c: o.start_col}) AS p FROM low e JOIN sym s ON s.symbol_id = e.src_symbol_id
  JOIN occ o ON o.file_id = s.file_id AND o.resolved_symbol_id = e.dst_symbol_id AND o.role = 'call' AND o.start_line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2, 3),
precise AS (SELECT e.src_symbol_id, s.name, min(e.dst_symbol_id) AS target FROM edg e JOIN sym s ON s.symbol_id = e.dst_symbol_id WHERE e.kind = 'calls' AND provenance = 'lsp' GROUP BY 1, 2),
facts AS (SELECT t.file_id, t.p, min(r.target) AS target FROM sites t JOIN sym s ON s.symbol_id = t.dst_symbol_id JOIN precise r ON r.src_symbol_id = t.src_symbol_id AND r.name = s.name GROUP BY 1, 2),
told AS (SELECT src_symbol_id, dst_symbol_id, min(target) AS target FROM sites JOIN facts USING (file_id, p) GROUP BY 1, 2),
kept AS (SELECT * FROM edg e WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.src_symbol_id = e.src_symbol_id AND t.dst_symbol_id = e.dst_symbol_id AND e.kind = 'calls')
  UNION ALL SELECT src_symbol_id, target, 'calls', 1.0, 'lsp' FROM told)
SELECT src_symbol_id, dst_symbol_id, kind, max(confidence) AS confidence, arg_max(provenance, {c: confidence, p: provenance}) AS provenance FROM kept GROUP BY 1, 2, 3""",
    "impact_bfs": _with(SYM, EDG, CHG, IMPACT, recursive=True) + "SELECT node AS symbol_id, depth, via FROM walked",
    "import_reach": _with(IMP, CHG, REACH, recursive=True) + "SELECT node AS file_id, depth FROM walked",
    "impact_files": _with(CUR, SYM, EDG, IMP, CHG, _TWO, _FILES_HIT, recursive=True) + "SELECT * FROM touched",
    "tests_for_changes": _with(CUR, SYM, EDG, IMP, CHG, _TWO, _FILES_HIT, recursive=True) + "SELECT file_id, path, depth, layer FROM touched WHERE is_test",
    "call_depths": _with(
        CUR, SYM, EDG,
        _walk("SELECT src_symbol_id AS a, dst_symbol_id AS t, confidence AS w FROM edg WHERE kind = 'calls' AND src_symbol_id <> dst_symbol_id", "SELECT symbol_id AS node FROM sym JOIN cur USING (file_id) WHERE is_test", 6),
        recursive=True,
    ) + "SELECT node AS symbol_id, depth, via FROM walked",
    "affected_files": _with(IMP, CHG)
    + "SELECT file_id FROM chg UNION SELECT i.file_id FROM imp i JOIN chg c ON c.file_id = i.resolved_file_id UNION SELECT file_id FROM occurrences WHERE name IN (SELECT name FROM symbols WHERE file_id IN (SELECT file_id FROM chg))",
    "degrees": _with(EDG)
    + """SELECT coalesce(a.k, b.k) AS symbol_id, coalesce(a.kind, b.kind) AS kind, coalesce(a.n, 0) AS n_in, coalesce(b.n, 0) AS n_out FROM (SELECT dst_symbol_id AS k, kind, count(*) AS n FROM edg GROUP BY 1, 2) a
FULL JOIN (SELECT src_symbol_id AS k, kind, count(*) AS n FROM edg GROUP BY 1, 2) b ON a.k = b.k AND a.kind = b.kind""",
    "bm25_topk": _with(CUR, SYM, BM25) + "SELECT query_id, symbol_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 20",
    "prefix_search": _with(CUR, SYM, TERMS)
    + """, cuts AS (SELECT DISTINCT length(term) AS n FROM terms), cut AS (SELECT DISTINCT symbol_id, substr(term, 1, n) AS term FROM post JOIN cuts ON length(term) >= n),
hits AS (SELECT query_id, symbol_id FROM terms JOIN cut USING (term) GROUP BY query_id, symbol_id, n_terms HAVING count(DISTINCT term) = n_terms)
SELECT query_id, count(*) AS n_hits, min(symbol_id) AS first_id, max(symbol_id) AS last_id FROM hits GROUP BY 1""",
    "rrf_hybrid": _with(CUR, SYM, BM25)
    + """, used AS (SELECT query_id, symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, symbol_id) AS rank FROM (SELECT DISTINCT query_id FROM terms) t JOIN sym s ON s.name = t.query_id
  JOIN (SELECT resolved_symbol_id AS symbol_id, count(*) AS n FROM occurrences GROUP BY 1) u USING (symbol_id)),
both_ AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.symbol_id, b.symbol_id) AS symbol_id, a.rank AS ra, b.rank AS rb FROM (SELECT * FROM ranked WHERE rank <= 50) a
  FULL JOIN (SELECT * FROM used WHERE rank <= 50) b ON a.query_id = b.query_id AND a.symbol_id = b.symbol_id),
fused AS (SELECT query_id, symbol_id, round(coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0), 9) AS score, ra, rb FROM both_)
SELECT query_id, symbol_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, symbol_id)::INTEGER AS rank FROM fused) WHERE rank <= 20""",
    "token_budget": _with(SYM)
    + r""", c AS (SELECT symbol_id, file_id, ceil(length(regexp_replace(signature, '\s+', ' ', 'g')) / 3.7)::BIGINT AS cost FROM sym WHERE signature IS NOT NULL),
s AS (SELECT file_id, sum(cost) OVER w AS spent, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY file_id ORDER BY symbol_id))
SELECT file_id, count(*) AS n_kept, max(spent)::BIGINT AS spent FROM s WHERE spent <= 400 OR rn = 1 GROUP BY 1""",
    "path_normalize": _with(CUR)
    + rf"""SELECT file_id, {DIR.format(p='path')} AS folder, {BASE.format(p='path')} AS base, lower(regexp_extract({BASE.format(p='path')}, '(\.[^.]*)$', 1)) AS ext,
CASE WHEN len(string_split(path, '/')) <= 2 THEN {BASE.format(p='path')} ELSE array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 2], '/') || '/' || {BASE.format(p='path')} END AS climbed FROM cur""",
    "longest_prefix_root": _with(CUR)
    + rf""", marks AS (SELECT DISTINCT {DIR.format(p='path')} AS root FROM cur WHERE regexp_matches({BASE.format(p='path')}, '^(__init__\.py|index\.[a-z]+|mod\.rs)$')),
above AS (SELECT file_id, array_to_string(parts[1:i], '/') AS root FROM (SELECT file_id, string_split(path, '/') AS parts, unnest(range(0, len(string_split(path, '/')))) AS i FROM cur))
SELECT file_id, arg_max(root, length(root)) AS root FROM above JOIN marks USING (root) GROUP BY 1""",
    "test_path_classify": _with(CUR)
    + rf"""SELECT lang, looks_like_test, is_test, count(*) AS n_files FROM (SELECT lang, is_test, coalesce(regexp_matches(path, '(^|/)(test|tests|__tests__|__mocks__|spec|specs|e2e|cypress)/') OR CASE lang
 WHEN 'python' THEN regexp_matches(b, '^(test_.*|.*_test|conftest)\.py$') WHEN 'typescript' THEN regexp_matches(b, '\.(test|spec|cy|e2e)\.[a-z]+$') WHEN 'javascript' THEN regexp_matches(b, '\.(test|spec|cy|e2e)\.[a-z]+$')
 WHEN 'go' THEN regexp_matches(b, '_test\.go$') WHEN 'java' THEN regexp_matches(b, '(Test|Tests|IT|TestCase)\.java$') OR regexp_matches(path, '(^|/)src/(test|androidTest)/')
 WHEN 'c_sharp' THEN regexp_matches(b, 'Tests?\.cs$') OR regexp_matches(path, '(^|/)[^/]*\.Tests?/') WHEN 'ruby' THEN regexp_matches(b, '_(spec|test)\.rb$') WHEN 'rust' THEN regexp_matches(b, '(_test|^tests)\.rs$')
 WHEN 'cpp' THEN regexp_matches(b, '(^test_.*|.*(_test|Test|_unittest))\.(cpp|cc|cxx)$') WHEN 'gdscript' THEN regexp_matches(b, '^test_.*\.gd$') ELSE false END, false) AS looks_like_test
 FROM (SELECT *, {BASE.format(p='path')} AS b FROM cur)) GROUP BY 1, 2, 3""",
    "dead_code_report": _with(CUR, SYM, DEAD)
    + rf"""SELECT symbol_id, name, path, CASE WHEN is_test THEN 'test' WHEN name IN (SELECT name FROM occurrences WHERE resolved_symbol_id IS NULL AND name IS NOT NULL) THEN 'maybe used by name' WHEN is_exported THEN 'exported' ELSE 'dead' END AS bucket
FROM dead WHERE NOT (regexp_matches({BASE.format(p='path')}, '^(main|index|app|server|cli|__main__)\.[a-z]+$') AND len(string_split(path, '/')) <= 3)
  AND NOT coalesce(CASE lang WHEN 'gdscript' THEN name LIKE '\_%' ESCAPE '\' WHEN 'python' THEN regexp_matches(name, '^__\w+__$')
    WHEN 'c_sharp' THEN name IN ('Awake', 'Start', 'Update', 'FixedUpdate', 'LateUpdate', 'OnEnable', 'OnDisable', 'OnDestroy', 'OnGUI', 'OnValidate', 'Reset', 'Main')
    WHEN 'cpp' THEN name IN ('main', 'BeginPlay', 'EndPlay', 'Tick') WHEN 'go' THEN name IN ('main', 'init') WHEN 'java' THEN name = 'main' WHEN 'rust' THEN name = 'main' END, false)""",
    "hotspots": _with(CUR)
    + "SELECT path, commits, n_lines, round(commits * log2(n_lines + 1), 6) AS score FROM (SELECT file_id, count(DISTINCT indexed_at) AS commits FROM files GROUP BY 1) JOIN (SELECT file_id, max(end_line) AS n_lines FROM symbols GROUP BY 1) USING (file_id) JOIN cur USING (file_id)",
    "outline_depth": _with(SYM, recursive=True)
    + """, link AS (SELECT s.symbol_id, s.file_id, s.start_line, s.kind, s.name, p.symbol_id AS parent FROM sym s LEFT JOIN sym p ON p.symbol_id = s.parent_symbol_id AND p.file_id = s.file_id),
down(symbol_id, depth) AS (SELECT symbol_id, 0 FROM link WHERE parent IS NULL UNION ALL SELECT l.symbol_id, d.depth + 1 FROM down d JOIN link l ON l.parent = d.symbol_id)
SELECT file_id, start_line, symbol_id, coalesce(depth, 0)::INTEGER AS depth, repeat('  ', coalesce(depth, 0)) || kind || ' ' || name AS line FROM link LEFT JOIN down USING (symbol_id)""",
    "asset_users": _with(AST, REF)
    + "SELECT string_split(path, '/')[1] || '/' || substr(target, 7) AS target_path, count(DISTINCT asset_id) AS n_assets, count(*) AS n_refs FROM ref JOIN ast USING (asset_id) WHERE starts_with(target, 'res://') GROUP BY 1",
}
# what follows a WITH list as another part of it
ORACLES = {k: v.replace("\n, ", ",\n") for k, v in ORACLES.items()}

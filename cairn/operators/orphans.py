"""References to records that do not exist, and what hangs on them.

Direct orphans are found field by field with left joins against the referred table and the list of removals. Then a
fixpoint runs down the foreign keys: a symbol below an orphaned symbol is an inherited orphan, and so are occurrences and
edges that refer to one. Each turn is one semi-join of the links against the orphans known so far; the links double in
length from turn to turn, so a chain of any depth costs a logarithmic number of turns and each turn has the same plan.

Defined results: a null reference is none; twice-delivered rows count once; a referring file or asset without a row has a
null period, and its references can be missing or deleted but not late; a null target is no case; a symbol that
is orphaned itself doesn't inherit; a reference can be late and inherit besides; tables may be empty. Edges have no id of their own:
their row_id is null and row_key is ``src>dst:kind``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairn.frames import current_files, day_of
from cairn.functions.paths import join_path, normalize_path, parent_dir, repository, tail
from cairn.session import Scratch

# How a relative specifier is completed, in this order.
SUFFIXES = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte"]
INDEX_FILES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx"]

COLUMNS = ["src_table", "field_name", "row_id", "reason", "period_day"]
ALL_COLUMNS = [*COLUMNS[:3], "row_key", *COLUMNS[3:], "level"]


def script_candidates(path: Column, specifier: Column) -> Column:
    """The paths a relative specifier of a script may mean, best first."""
    base = normalize_path(join_path(parent_dir(path), specifier))
    stem = F.regexp_replace(base, r"\.(js|mjs|cjs|jsx)$", "")
    ending = F.regexp_extract(base, r"\.(js|mjs|cjs|jsx)$", 1)
    twin = F.when(ending == "mjs", F.concat(stem, F.lit(".mts"))).when(ending == "cjs", F.concat(stem, F.lit(".cts")))
    twin = twin.when(ending != "", F.concat(stem, F.lit(".ts")))
    twin_x = F.when(ending.isin("js", "jsx"), F.concat(stem, F.lit(".tsx")))
    rest = [base, *[F.concat(base, F.lit(x)) for x in SUFFIXES + INDEX_FILES]]
    return F.filter(F.array(twin, twin_x, *rest), lambda x: x.isNotNull())


def _by_id(refs: DataFrame, known: DataFrame, removed: DataFrame) -> DataFrame:
    """refs: row_id, ref, period_day. known: id, day. removed: id."""
    hit = known.select(F.col("id").alias("kid"), F.col("day"), F.lit(True).alias("there"))
    gone = removed.select(F.col("id").alias("gid")).distinct()
    late = F.col("there") & (F.col("day") > F.col("period_day"))
    odd = (
        refs.join(hit, F.col("ref") == F.col("kid"), "left")
        .where(F.col("there").isNull() | late)
        .select("row_id", "ref", "period_day", "there")
    )
    reason = F.when(F.col("there"), F.lit("late")).when(F.col("gid").isNotNull(), F.lit("deleted")).otherwise(F.lit("missing"))
    return odd.join(gone, F.col("ref") == F.col("gid"), "left").select("row_id", reason.alias("reason"), "period_day")


def direct_orphans(t: dict[str, DataFrame], of_file: DataFrame, symbols: DataFrame) -> DataFrame:
    """src_table, field_name, row_id, reason, period_day.

    t: files, imports, occurrences, assets, asset_refs, removals. of_file: fid, path, lang, period_day of the current files;
    symbols: symbol_id and the period_day of their files.
    """
    days = of_file.select("fid", "period_day")
    removals = t["removals"].select("rec_table", F.col("rec_id").alias("id"))
    known_files = of_file.select(F.col("fid").alias("id"), F.col("period_day").alias("day"))
    known_symbols = symbols.select(F.col("symbol_id").alias("id"), F.col("period_day").alias("day"))

    occ = t["occurrences"].where("resolved_symbol_id is not null").select(
        F.col("occ_id").alias("row_id"), "file_id", F.col("resolved_symbol_id").alias("ref")
    )
    occ = occ.join(days, F.col("file_id") == F.col("fid"), "left").select("row_id", "ref", "period_day")
    found = [_by_id(occ, known_symbols, removals.where("rec_table = 'symbols'")).withColumns({"src_table": F.lit("occurrences"), "field_name": F.lit("resolved_symbol_id")})]

    imports = t["imports"].select(F.col("import_id").alias("row_id"), "file_id", "specifier", F.col("resolved_file_id").alias("ref"))
    imports = imports.join(of_file, F.col("file_id") == F.col("fid"), "left")
    found.append(
        _by_id(imports.where("ref is not null").select("row_id", "ref", "period_day"), known_files, removals.where("rec_table = 'files'"))
        .withColumns({"src_table": F.lit("imports"), "field_name": F.lit("resolved_file_id")})
    )
    paths = t["files"].where("path is not null").select(F.col("path").alias("p")).distinct()
    relative = imports.where("ref is null and lang in ('typescript', 'javascript') and startswith(specifier, '.')")
    relative = relative.select("row_id", "path", "specifier", "period_day").distinct()
    leads = (
        relative.select("row_id", F.explode(script_candidates(F.col("path"), F.col("specifier"))).alias("c"))
        .join(paths, F.col("c") == F.col("p"), "left_semi")
        .select(F.col("row_id").alias("ok_id"))
        .distinct()
    )
    found.append(
        relative.join(leads, F.col("row_id") == F.col("ok_id"), "left_anti").select(
            "row_id", F.lit("missing").alias("reason"), "period_day", F.lit("imports").alias("src_table"), F.lit("specifier").alias("field_name")
        )
    )

    assets = t["assets"].where("asset_id is not null").groupBy(F.col("asset_id").alias("aid")).agg(
        F.max_by("path", F.struct("indexed_at", "path")).alias("apath"), day_of(F.max("indexed_at")).alias("period_day")
    )
    refs = t["asset_refs"].where("target is not null").select(F.col("ref_id").alias("row_id"), "asset_id", "target_kind", "target").distinct()
    refs = refs.join(assets, F.col("asset_id") == F.col("aid"), "left")
    on_disk = of_file.select(F.col("path").alias("p"), F.col("period_day").alias("day"))
    old = t["files"].select(F.col("path").alias("p"), F.lit(None).cast("string").alias("day"))
    there = (
        on_disk.unionByName(old)
        .unionByName(t["assets"].select(F.col("path").alias("p"), F.lit("").alias("day")))
        .where("p is not null")
        .groupBy("p")
        # an asset of that path is there whatever the file's day
        .agg(F.max(F.when(F.col("day") == "", F.lit(None)).otherwise(F.col("day"))).alias("day"), F.lit(True).alias("there"))
    )
    res = refs.where("startswith(target, 'res://')").withColumn(
        "full", normalize_path(join_path(repository(F.coalesce("apath", F.lit(""))), tail(F.col("target"), 7)))
    )
    found.append(
        res.join(there, F.col("full") == F.col("p"), "left")
        .withColumn("reason", F.when(F.col("there").isNull(), F.lit("missing")).when(F.col("day") > F.col("period_day"), F.lit("late")))
        .where("reason is not null")
        .select("row_id", "reason", "period_day", F.lit("asset_refs").alias("src_table"), F.lit("target").alias("field_name"))
    )
    named = refs.where("target_kind = 'guid_of'").select(F.lower("target").alias("g")).distinct()
    guids = refs.where("target_kind <> 'guid_of' and target rlike '^[0-9a-fA-F]{32}$' and not startswith(target, '0000000000000000')")
    found.append(
        guids.join(named, F.lower("target") == F.col("g"), "left_anti").select(
            "row_id", F.lit("missing").alias("reason"), "period_day", F.lit("asset_refs").alias("src_table"), F.lit("target").alias("field_name")
        )
    )
    out = found[0].select(COLUMNS)
    for more in found[1:]:
        out = out.unionByName(more.select(COLUMNS))
    return out.distinct()


def owner_orphans(t: dict[str, DataFrame], files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows whose own file, asset or edge end is gone: the fields that name what a row belongs to."""
    removed = t["removals"].select("rec_table", F.col("rec_id").alias("gid")).distinct()
    gone = F.when(F.col("gid").isNotNull(), F.lit("deleted")).otherwise(F.lit("missing")).alias("reason")

    def missing(rows: DataFrame, known: DataFrame, table: str) -> DataFrame:
        lost = rows.where("ref is not null").join(known.select(F.col("id").alias("kid")), F.col("ref") == F.col("kid"), "left_anti")
        return lost.join(removed.where(F.col("rec_table") == table), F.col("ref") == F.col("gid"), "left").select(
            "src_table", "field_name", "row_id", "row_key", gone, "period_day"
        )

    none, nobody = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    by_file = files.select(F.col("fid").alias("id"))
    out = None
    for name, key in (("occurrences", "occ_id"), ("imports", "import_id")):
        rows = t[name].select(
            F.lit(name).alias("src_table"), F.lit("file_id").alias("field_name"), F.col(key).alias("row_id"), none.alias("row_key"),
            F.col("file_id").alias("ref"), none.alias("period_day"),
        )
        part = missing(rows, by_file, "files")
        out = part if out is None else out.unionByName(part)
    refs = t["asset_refs"].select(
        F.lit("asset_refs").alias("src_table"), F.lit("asset_id").alias("field_name"), F.col("ref_id").alias("row_id"), none.alias("row_key"),
        F.col("asset_id").alias("ref"), none.alias("period_day"),
    )
    out = out.unionByName(missing(refs, t["assets"].select(F.col("asset_id").alias("id")), "assets"))
    by_symbol = symbols.select(F.col("symbol_id").alias("id"))
    # an edge's day is that of the file its source lies in
    source = symbols.select(F.col("symbol_id").alias("sid"), F.col("period_day").alias("day"))
    for end in ("src_symbol_id", "dst_symbol_id"):
        rows = edge_rows(t["edges"]).select(
            F.lit("edges").alias("src_table"), F.lit(end).alias("field_name"), nobody.alias("row_id"), "row_key", F.col(end).alias("ref"), "src_symbol_id"
        )
        lost = missing(rows.withColumn("period_day", F.col("src_symbol_id").cast("string")), by_symbol, "symbols")
        lost = lost.join(source, F.col("period_day").cast("bigint") == F.col("sid"), "left").withColumn("period_day", F.col("day")).drop("sid", "day")
        out = out.unionByName(lost)
    return out.distinct()


def edge_rows(edges: DataFrame) -> DataFrame:
    """One row for each edge (source, target, kind) with its key."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat(part("src_symbol_id"), F.lit(">"), part("dst_symbol_id"), F.lit(":"), part("kind"))
    return edges.select("src_symbol_id", "dst_symbol_id", key.alias("row_key")).distinct()


def fallen_symbols(links: DataFrame, fallen: DataFrame, scratch: Scratch) -> DataFrame:
    """symbol_id, reason, level of the orphaned symbols below ``fallen`` (symbol_id, reason) and of these (level 0).

    links: symbol_id, parent; one row a symbol. A fallen symbol ends the links, so a level is the distance to the nearest
    one above, and circles, which hold none, are never entered.
    """
    found = [scratch.save(fallen.groupBy("symbol_id").agg(F.min("reason").alias("reason")).withColumn("level", F.lit(0).cast("bigint")), "level")]
    ends = found[0].select(F.col("symbol_id").alias("end"))
    links = scratch.save(
        links.where("parent is not null").join(ends, F.col("symbol_id") == F.col("end"), "left_anti").select(F.col("symbol_id").alias("low"), F.col("parent").alias("high")),
        "links",
    )
    reach = 1
    while True:
        known = scratch.together(found)
        # orphans between ``reach`` and twice as many links down
        seen = Observation()
        below = (
            links.join(known, F.col("high") == F.col("symbol_id"))
            .select(F.col("low").alias("symbol_id"), "reason", (F.col("level") + reach).alias("level"))
            .hint("rebalance")
            .observe(seen, F.count(F.lit(1)).alias("n"))
        )
        found.append(scratch.save(below, "level"))
        if not seen.get["n"]:
            break
        upper = links.select(F.col("low").alias("middle"), F.col("high").alias("top"))
        links = scratch.save(links.join(upper, F.col("high") == F.col("middle")).select("low", F.col("top").alias("high")), "links")
        reach *= 2
    return scratch.together(found)


def orphan_cascade(t: dict[str, DataFrame]) -> DataFrame:
    """The direct orphans (level 0) and those that inherit it, with the number of links down to them.

    A symbol whose parent_symbol_id or file_id names no row is a direct orphan too, as is an occurrence, import, asset
    reference or edge whose file, asset or end is gone; the child symbols of an orphaned symbol, then theirs, and the
    occurrences and edges that refer to any of them inherit.
    """
    scratch = Scratch(t["symbols"].sparkSession, "orphans")
    of_file = current_files(t["files"]).select(F.col("file_id").alias("fid"), "path", "lang", F.col("first_day").alias("period_day"))
    of_file = scratch.save(of_file, "files")
    files = of_file.select("fid", "period_day")
    symbols = (
        t["symbols"].where("symbol_id is not null").groupBy("symbol_id").agg(F.min("file_id").alias("file_id"), F.min("parent_symbol_id").alias("parent"))
    )
    symbols = scratch.save(symbols.join(files, F.col("file_id") == F.col("fid"), "left"), "symbols")
    removed = t["removals"].select("rec_table", F.col("rec_id").alias("gid")).distinct()
    reason = F.when(F.col("gid").isNotNull(), F.lit("deleted")).otherwise(F.lit("missing"))
    present = symbols.select(F.col("symbol_id").alias("pid"))

    def own(rows: DataFrame, field: str, ref: str, table: str) -> DataFrame:
        gone = rows.join(removed.where(F.col("rec_table") == table), F.col(ref) == F.col("gid"), "left")
        return gone.select("symbol_id", "period_day", F.lit(field).alias("field_name"), reason.alias("reason"))

    rootless = symbols.where("parent is not null").join(present, F.col("parent") == F.col("pid"), "left_anti")
    fallen = own(rootless, "parent_symbol_id", "parent", "symbols").unionByName(
        own(symbols.where("file_id is not null and fid is null"), "file_id", "file_id", "files")
    )
    fallen = scratch.save(fallen, "fallen")
    bad = fallen_symbols(symbols.select("symbol_id", "parent"), fallen, scratch).withColumnRenamed("symbol_id", "bid")

    none, nobody = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    own_rows = fallen.select(
        F.lit("symbols").alias("src_table"), "field_name", F.col("symbol_id").alias("row_id"), none.alias("row_key"), "reason", "period_day",
        F.lit(0).cast("bigint").alias("level"),
    )
    heirs = bad.where("level > 0").join(symbols.select("symbol_id", "period_day"), F.col("bid") == F.col("symbol_id")).select(
        F.lit("symbols").alias("src_table"), F.lit("parent_symbol_id").alias("field_name"), F.col("bid").alias("row_id"), none.alias("row_key"),
        "reason", "period_day", "level",
    )
    occ = t["occurrences"].where("resolved_symbol_id is not null").select("occ_id", "file_id", "resolved_symbol_id")
    uses = occ.join(bad, F.col("resolved_symbol_id") == F.col("bid")).join(files, F.col("file_id") == F.col("fid"), "left").select(
        F.lit("occurrences").alias("src_table"), F.lit("resolved_symbol_id").alias("field_name"), F.col("occ_id").alias("row_id"), none.alias("row_key"),
        "reason", "period_day", (F.col("level") + 1).alias("level"),
    )
    days = symbols.select(F.col("symbol_id").alias("sid"), "period_day")
    edges = None
    for end in ("src_symbol_id", "dst_symbol_id"):
        part = edge_rows(t["edges"]).join(bad, F.col(end) == F.col("bid")).join(days, F.col("src_symbol_id") == F.col("sid"), "left").select(
            F.lit("edges").alias("src_table"), F.lit(end).alias("field_name"), nobody.alias("row_id"), "row_key", "reason", "period_day",
            (F.col("level") + 1).alias("level"),
        )
        edges = part if edges is None else edges.unionByName(part)
    direct = direct_orphans(t, of_file, symbols).withColumn("row_key", none).unionByName(owner_orphans(t, files, symbols)).withColumn("level", F.lit(0).cast("bigint"))
    out = direct.select(ALL_COLUMNS)
    for more in (own_rows, heirs, uses.distinct(), edges):
        out = out.unionByName(more.select(ALL_COLUMNS))
    return out


def orphan_counts(cascade: DataFrame) -> DataFrame:
    """Per table, field, day and reason: direct and inherited orphans."""
    return cascade.groupBy("src_table", "field_name", "period_day", "reason").agg(
        F.count_if(F.col("level") == 0).alias("n_direct"), F.count_if(F.col("level") > 0).alias("n_inherited")
    )

"""The queries p1, p5 to p10 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.frames import current_files, table
from cairn.functions.paths import repository
from cairn.llm import docpairs, mixing, parsing, provenance, residue, tokens, vectors


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    return provenance.judge(table(spark, d, "sources", "path", "content"), table(spark, d, "known_libraries", "file_hash"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    judged, _ = _judged(spark, d)
    return judged.where(F.size("kinds") > 0).select("path", "kinds").join(_current(spark, d), "path").select("file_id", "kinds")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).select("file_id").distinct()


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each file is that was not written by hand where it lies."""
    return _kinds(spark, d)


def p1_validation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of each classifier, against the labels of repositories that had no part in fit or thresholds."""
    _, report = _judged(spark, d)
    rows = [(h, float(r["precision"]), float(r["recall"]), int(r["n"])) for h, r in report.items()]
    return spark.createDataFrame(rows, "head string, precision double, recall double, n_held_out long")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_vectors", "chunk_id", "embedding")
    pairs = vectors.similar_pairs(rows, "chunk_id", "embedding", 0.95)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Every usable vector with its class of copies and how many other vectors are near it."""
    rows = table(spark, d, "chunk_vectors", "chunk_id", "embedding")
    return vectors.similar_links(rows, "chunk_id", "embedding", 0.95).withColumnRenamed("id", "chunk_id")


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_vectors", "chunk_id", "embedding")
    near = vectors.nearest_rows(rows, "chunk_id", "embedding", 10)
    return near.select(F.col("id").alias("chunk_id"), "rank", F.col("neighbour_id").alias("neighbour_chunk_id"), F.round("cosine", 5).alias("cosine"))


def _pairs(spark: SparkSession, d: str, with_code: bool) -> DataFrame:
    files = _current(spark, d)
    symbols = table(spark, d, "symbols", "symbol_id", "file_id", "name", "kind", "start_line", "signature", "doc_comment")
    return docpairs.doc_pairs(symbols, files, table(spark, d, "sources", "path", "content"), with_code)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, False).select("symbol_id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code with the comment that was found at it (the index's for a file without a text)."""
    return _pairs(spark, d, True).select("symbol_id", "lang", "readable", "code", "comment", "doc")


def _current(spark: SparkSession, d: str) -> DataFrame:
    files = current_files(table(spark, d, "files", "file_id", "path", "lang", "indexed_at", "is_test"))
    return files.select("file_id", "path", "lang")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """file_id, valid, error_line, error_token."""
    return parsing.check_files(_current(spark, d), table(spark, d, "sources", "path", "content"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("not valid").select("file_id").distinct()


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on each file with its first error."""
    return _checked(spark, d)


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files per repository and language, beside what the indexing runs complained about."""
    verdict = _checked(spark, d).groupBy(F.col("file_id").alias("vid")).agg(F.min("valid").alias("valid"))
    hints = table(spark, d, "index_errors", "path").where("path is not null").distinct().select(F.col("path").alias("hp"))
    files = _current(spark, d).join(hints, F.col("path") == F.col("hp"), "left")
    rows = files.join(verdict, F.col("file_id") == F.col("vid")).select(
        repository(F.col("path")).alias("repo"), "lang", "valid", F.col("hp").isNotNull().alias("hinted")
    )
    return parsing.error_rates(rows)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tokens.token_ids("text").alias("ids"))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    docs = table(spark, d, "documents", "doc_id", "text", "source", "lang", "doc_kind").withColumnRenamed("doc_kind", "topic")
    return mixing.Mixture(docs, table(spark, d, "mix_targets", "source", "weight", "max_repeats"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).selection()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).marginals()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text")).select(F.col("id").alias("doc_id"))


def p10_rest(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay."""
    rows = table(spark, d, "documents", "doc_id", "text")
    return rows.select("doc_id").join(residue.residue(rows).select(F.col("id").alias("doc_id")), "doc_id", "left_anti").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_kinds": p1_kinds,
    "p1_validation": p1_validation,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p5_nearest": p5_nearest,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_found": p7_found,
    "p7_files": p7_files,
    "p7_rates": p7_rates,
    "p8_ids": p8_ids,
    "p9_selection": p9_selection,
    "p9_report": p9_report,
    "p9_marginals": p9_marginals,
    "p10_found": p10_found,
    "p10_rest": p10_rest,
}
_P5 = """vecs AS (
  SELECT chunk_id AS id, any_value(embedding) AS v FROM chunk_vectors
  WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND list_sum(list_transform(embedding, lambda e: e::DOUBLE * e)) > 0 GROUP BY 1),
unit AS (SELECT id, v, list_transform(v, lambda e: e::DOUBLE) AS d FROM vecs),
pairs AS (
  SELECT a.id AS a, b.id AS b FROM unit a JOIN unit b ON a.id < b.id
  WHERE a.v = b.v OR list_inner_product(a.d, b.d) / sqrt(list_inner_product(a.d, a.d) * list_inner_product(b.d, b.d)) >= 0.95)"""

ORACLES: dict[str, str] = {
    # every usable vector against every other
    "p5_found": f"WITH {_P5} SELECT a AS chunk_id_a, b AS chunk_id_b FROM pairs",
    "p5_links": f"""WITH {_P5},
classes AS (SELECT id, min(id) OVER (PARTITION BY v) AS class_id, count(*) OVER (PARTITION BY v) AS n_copies FROM unit),
both_ways AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs),
links AS (SELECT id, count(*) AS n FROM both_ways GROUP BY 1)
SELECT c.id AS chunk_id, class_id, n_copies, coalesce(n, 0) AS n_links FROM classes c LEFT JOIN links l USING (id)""",
}

"""Queries of the problems of training data, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import byte_bpe, hidden_copies, leakage, match_groups, quality


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_copies.copies(_read(spark, sf_dir, "examples"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per link with the number of its copies."""
    return hidden_copies.collapsed(_read(spark, sf_dir, "examples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups.name_groups(_read(spark, sf_dir, "examples"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_ids(_read(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, decoded from their ids."""
    return byte_bpe.token_texts(byte_bpe.token_ids(_read(spark, sf_dir, "documents")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(*(_read(spark, sf_dir, t) for t in ("documents", "eval_items", "stock_phrases")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases with the place of the repeated stretch in the original text."""
    return _leaks(spark, sf_dir)


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each text."""
    return quality.text_statistics(_read(spark, sf_dir, "documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics with the outlier score within the language and its rank."""
    return quality.outlier_scores(_read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.no_prose(_read(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p3_found, p6_ids, p6_decoded, p7_found, p7_spans, p8_stats, p8_scores, p8_found)}

_PLAIN = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_LINKS = f"""links AS (
    SELECT line_id, least(a, b) AS lo, greatest(a, b) AS hi FROM (
        SELECT line_id, {_PLAIN.format('c0')} AS a, {_PLAIN.format('c1')} AS b FROM examples WHERE c0 IS NOT NULL AND c1 IS NOT NULL) t
    WHERE a <> '' AND b <> '')"""

ORACLES = {
    "p1_found": f"""
        WITH {_LINKS}, k AS (SELECT line_id, min(line_id) OVER (PARTITION BY lo, hi) AS keep_id FROM links)
        SELECT keep_id, line_id AS copy_id FROM k WHERE line_id > keep_id""",
    "p1_links": f"""
        WITH {_LINKS} SELECT min(line_id) AS keep_id, count(*) AS n_copies FROM links GROUP BY lo, hi""",
    "p3_found": f"""
        WITH RECURSIVE {_LINKS}, e AS MATERIALIZED (SELECT DISTINCT lo AS a, hi AS b FROM links UNION SELECT hi, lo FROM links),
        g(name, group_name) USING KEY (name) AS (
            SELECT a, min(b) FROM (SELECT a, b FROM e UNION ALL SELECT a, a FROM e) t GROUP BY a
          UNION
            SELECT e.b, min(g.group_name) FROM g JOIN e ON e.a = g.name JOIN recurring.g k ON k.name = e.b
            GROUP BY e.b HAVING min(g.group_name) < min(k.group_name))
        SELECT name, group_name FROM g""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

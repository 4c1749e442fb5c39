"""Queries of the general data-processing problems 2, 4 and 5, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import plain_form
from graphloom.operators import frequency, hierarchy, rowparse


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.last_by_plain_name(_read(spark, sf_dir, "examples"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plain form of c0: its last row, rows, spellings and the most frequent spelling."""
    return frequency.names_report(_read(spark, sf_dir, "examples"))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plain form of c0: rows, distinct weights and the most frequent weight."""
    key = plain_form("c0")
    out = frequency.key_profile(_read(spark, sf_dir, "examples"), F.when(key != "", key), "c2")
    return out.withColumnRenamed("key", "name")


def p2_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plain form of c0 the exact lower median of the weights."""
    key = plain_form("c0")
    out = frequency.key_percentile(_read(spark, sf_dir, "examples"), F.when(key != "", key), "c2", 0.5)
    return out.select(F.col("key").alias("name"), F.col("percentile").alias("median"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowparse.parse_rows(_read(spark, sf_dir, "examples_raw")).filter(F.col("reason").isNotNull()).select("raw_id", "reason")


def p4_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing lines with the first broken field."""
    return rowparse.parse_rows(_read(spark, sf_dir, "examples_raw")).filter(F.col("reason").isNotNull()).select("raw_id", "bad_field", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows."""
    return rowparse.parse_rows(_read(spark, sf_dir, "examples_raw")).filter(F.col("reason").isNull()).select("raw_id", "c0", "c1", "c2")


def p5_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, root, subtree size and circle of each vertex."""
    tree = hierarchy.hierarchy(hierarchy.community_parents(_read(spark, sf_dir, "louvaindata")), paths=False)
    return tree.select(F.col("node").alias("vertex_id"), "root", "depth", "subtree", "cycle")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.hierarchy(hierarchy.community_parents(_read(spark, sf_dir, "louvaindata")))
    path = F.when(F.col("cycle").isNotNull(), F.concat(F.lit("cycle "), F.col("cycle").cast("string"))).otherwise(F.array_join(F.col("path").cast("array<string>"), "/"))
    return tree.select(F.col("node").alias("vertex_id"), path.alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of ancestor and descendant with their distance."""
    return hierarchy.descendants(hierarchy.hierarchy(hierarchy.community_parents(_read(spark, sf_dir, "louvaindata"))))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_profile, p2_median, p4_found, p4_broken, p4_loaded, p5_found, p5_tree, p5_descendants)}

"""Graphs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.graph import reverse_duplicated


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _one():
    return F.lit(1).cast("bigint").alias("weight")


def supp_part_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, of large returned positions."""
    rows = read(spark, sf_dir, "lineitem").filter("l_quantity = 50 and l_returnflag = 'R'")
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), _one())


def user_sequence(spark: SparkSession, sf_dir: str, errors: bool = False) -> DataFrame:
    """From the user of each event to that of the next in time; ``errors``: of large errors alone.

    The order is one over all events: users are put in line with the event before by range partitions, each of which
    hands its last event on to the next."""
    from graphloom.scratch import Scratch

    events = read(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    tables = Scratch(spark, "sequence")
    ranged = events.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").withColumn("part", F.spark_partition_id())
    ranged = tables.table(ranged, "events")
    lasts = ranged.groupBy("part").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))  # one row a partition
    carried = lasts.select("part", F.lag("last").over(W.orderBy("part")).alias("carried"))
    before = F.lag("user_id").over(W.partitionBy("part").orderBy("ts", "event_id"))
    rows = ranged.withColumn("before", before).join(F.broadcast(carried), "part").withColumn("src", F.coalesce("before", "carried"))
    if errors:
        rows = rows.filter("event_type = 'error' and value > 150")
    return rows.filter(F.col("src").isNotNull()).select("src", F.col("user_id").alias("dst"), _one())


def user_errors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse_duplicated(user_sequence(spark, sf_dir, errors=True))


def part_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part to the next of its order."""
    following = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", following.alias("dst"))
    return rows.filter(F.col("dst").isNotNull()).select(F.col("l_partkey").alias("src"), "dst", _one())


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the suppliers' nations to the customers', one edge a position."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = rows.join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey")
    rows = rows.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst")), "o_custkey")
    return rows.select("src", "dst", _one())


def numeric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric edge table; null weights count 1, edges without a target are left out."""
    rows = read(spark, sf_dir, "edges_numeric").dropna(subset=["src", "dst"])
    return rows.select("src", "dst", F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"))

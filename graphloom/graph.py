"""Graphs as DataFrames: edges (src, dst, weight) and vertices (id). Ids are of any ordered type, and their order is
that of the rules that compare them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_of(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """Columns of any table as edges; the weight is 1 unless a column is named. Rows with a null end are left out."""
    w = F.lit(1).cast("bigint") if weight is None else F.coalesce(F.col(weight).cast("bigint"), F.lit(1))
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("weight")).dropna(subset=["src", "dst"])


def reverse_duplicated(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, in one pass; loops appear twice."""
    turned = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("weight"))
    return edges.select(F.inline(F.array(F.struct("src", "dst", "weight"), turned)))


def merge_parallel(edges: DataFrame) -> DataFrame:
    """One edge a direction and pair, with the summed weight."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").cast("bigint").alias("weight"))


def distinct_nodes(edges: DataFrame) -> DataFrame:
    """id of every end of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    """id, degree: edges leaving each node, parallel ones counted; nodes without any are absent."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    """id, weight: of all edges at the node in either direction; a loop counts twice."""
    both = F.array(F.struct(F.col("src").alias("id"), F.col("weight").alias("weight")), F.struct(F.col("dst").alias("id"), F.col("weight").alias("weight")))
    return edges.select(F.inline(both)).groupBy("id").agg(F.sum("weight").cast("bigint").alias("weight"))


def node_dictionary(edges: DataFrame, order: str = "name") -> DataFrame:
    """name, id: a dense number from 0 for every node, in the order of the names.

    The numbers are ranks over range partitions: names are sorted across partitions, and each partition starts where
    the ones before it end, so no task sees all names.
    """
    from graphloom.scratch import Scratch

    tables = Scratch(edges.sparkSession, "dictionary")
    names = distinct_nodes(edges).withColumnRenamed("id", "name")
    return dense_ranks(names, ["name"], tables).select("name", "id")


def dense_ranks(df: DataFrame, order: list[str], tables) -> DataFrame:
    """df (of distinct order columns) with id, the row's place from 0 in that order."""
    from pyspark.sql import Window as W

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = tables.table(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))  # one row a partition
    before = sizes.select("_part", (F.sum("_m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_m")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("id", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_part", "_in", "_before")


def encode(edges: DataFrame, dictionary: DataFrame, rows: int) -> DataFrame:
    """The edges with the numbers of a dictionary (name, id) for their ends; hubs are salted."""
    from graphloom.balance import lookup

    names = dictionary.select(F.col("name").alias("src"), F.col("id").alias("_s"))
    out = lookup(edges, names, "src", rows, "dst", "inner").drop("src")
    names = dictionary.select(F.col("name").alias("dst"), F.col("id").alias("_d"))
    out = lookup(out, names, "dst", rows, "_s", "inner").drop("dst")
    return out.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight")


def subgraph(edges: DataFrame, keep: DataFrame, rows: int) -> DataFrame:
    """The edges both of whose ends are among the ids of keep, which are unique; hubs are salted."""
    from graphloom.balance import lookup

    out = lookup(edges, keep.select(F.col("id").alias("src")), "src", rows, "dst", "inner")
    return lookup(out, keep.select(F.col("id").alias("dst")), "dst", rows, "src", "inner").select(*edges.columns)

"""Community graphs as text: id, internal weight, and ``target:weight`` pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def community_rows(lines: DataFrame) -> DataFrame:
    """id, internalWeight, edges (text) from TAB-separated lines; fewer than two fields are an error."""
    f = F.split("value", "\t")
    wrong = F.raise_error(F.concat(F.lit("too few fields: "), F.col("value")))
    return lines.select(
        F.when(F.size(f) >= 2, f[0]).otherwise(wrong).alias("id"), F.when(F.size(f) >= 2, f[1]).otherwise(wrong).cast("bigint").alias("internalWeight"),
        F.when(F.size(f) >= 3, f[2]).alias("edges"),
    )


def community_edges(rows: DataFrame) -> DataFrame:
    """src, dst, weight of the ``t:w,t:w`` lists: stray commas are skipped, a part without a weight counts 1, repeated
    targets add up. Edges of repeated rows add up as well."""
    part = rows.select(F.col("id").alias("src"), F.explode(F.split("edges", ",")).alias("p")).filter(F.trim("p") != "")
    target = F.trim(F.split("p", ":")[0])
    weight = F.coalesce(F.try_element_at(F.split("p", ":"), F.lit(2)).try_cast("bigint"), F.lit(1).cast("bigint"))
    return part.select("src", target.alias("dst"), weight.alias("weight")).filter("dst <> ''").groupBy("src", "dst").agg(F.sum("weight").cast("bigint").alias("weight"))


def community_states(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a stage from such rows, with the columns of the Louvain operators: the node weight is the
    sum of the weights of the vertex's edges, its community is itself. Repeated rows of a vertex are parts of its edges,
    which add up, but each states its whole internal weight, of which the largest counts; null is 0."""
    edges = community_edges(rows)
    own = rows.groupBy("id").agg(F.max(F.coalesce("internalWeight", F.lit(0))).cast("bigint").alias("internalWeight"))
    weights = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").cast("bigint").alias("nw"))
    v = own.join(weights, "id", "left").withColumn("nodeWeight", F.coalesce("nw", F.lit(0)).cast("bigint"))
    return v.select(
        "id", F.col("id").alias("name"), F.col("id").alias("community"), F.col("id").alias("communityName"),
        (F.col("nodeWeight") + F.col("internalWeight")).alias("communitySigmaTot"), "internalWeight", "nodeWeight", F.lit(False).alias("changed"),
    ), edges

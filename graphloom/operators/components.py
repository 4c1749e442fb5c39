"""Weakly connected components by alternating star contraction: a logarithmic number of rounds at any diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.balance import lookup
from graphloom.graph import distinct_nodes
from graphloom.operators.bsp import propagate
from graphloom.scratch import Scratch


def components(edges: DataFrame, label: str = "max") -> DataFrame:
    """id, component: each node with the largest (or smallest: label="min") id of its weakly connected component.

    Direction, weights, parallel edges and loops do not matter; edges with a null end are ignored; a node known by a
    loop alone is its own component. Ids of text compare by code points, numbers as numbers. Large star then small
    star: every node links its larger neighbours, then its smaller ones, to its least neighbour, until nothing
    changes. Minima are pre-aggregated, and the joins that hand them back are salted for hubs.
    """
    tables = Scratch(edges.sparkSession, "components")
    ends = edges.select("src", "dst").dropna()
    nodes = distinct_nodes(ends)
    links = ends.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    links = tables.table(links, "links", mark=mark)
    while links.row_count:
        both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup(both.filter("v > u"), least, "u", 2 * links.row_count, "v", "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.table(large, "large", mark=mark)
        # nothing moved, and every node has one link: all components are stars around their least node
        if (large.row_count, large.metrics["mark"]) == (links.row_count, links.metrics["mark"]) and large.select("u").distinct().count() == large.row_count:
            break
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = lookup(large, least, "u", large.row_count, "v", "inner")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = tables.table(small, "links", mark=mark)
        tables.drop(links, large)
        links = small
    roots = nodes.join(links.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    if label == "min":
        return roots.select("id", F.col("root").alias("component"))
    roots = tables.table(roots, "roots")
    top = roots.groupBy("root").agg(F.max("id").alias("component"))
    return lookup(roots, top, "root", roots.row_count, "id", "inner").select("id", "component")


def components_text(edges: DataFrame, bidirectional: bool = False, max_rounds: int | None = None) -> DataFrame:
    """id, component by text order, with labels that travel along edges only in their direction.

    Each node starts with the largest of its own id and those it points to, and hands its label to those it points to.
    With ``bidirectional`` the input is taken in both directions, which gives true components.
    """
    text = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    if bidirectional:
        return components(text, "max")
    ends = text.dropna()
    first = ends.groupBy(F.col("src").alias("id")).agg(F.max("dst").alias("far"))
    nodes = distinct_nodes(ends).join(first, "id", "left")
    out = propagate(
        nodes, ends, F.col("value"), F.max, F.greatest("value", "msg"), F.greatest("id", "far"), F.col("new") > F.col("value"), "out", max_rounds
    )
    return out.select("id", F.col("value").alias("component"))

"""Leaf compression: the core left when nodes with fewer than two ways out are peeled, and folding of such leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.balance import lookup
from graphloom.graph import distinct_nodes, out_degree, subgraph
from graphloom.operators.bsp import rounds
from graphloom.scratch import Scratch


def leaf_compression(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """The edges (all columns) of the largest subgraph in which every node has at least two edges out, parallel ones
    counted. Each round keeps edges whose ends both have two ways out, by pre-aggregated degrees. Null ends are left out."""
    tables = Scratch(edges.sparkSession, "leaf")
    state = tables.table(edges.dropna(subset=["src", "dst"]), "edges")
    for _ in rounds(max_rounds, "leaf compression"):
        keep = out_degree(state).filter("degree > 1").select("id")
        rest, before = tables.table(subgraph(state, keep, state.row_count), "edges"), state
        done = rest.row_count in (0, before.row_count)
        tables.drop(before)
        state = rest
        if done:
            break
    return state


def leaf_folding(edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges left with all their columns, nodes left with value): nodes with exactly one edge out are folded, round by round, into the node it
    leads to, whose value grows by one and by the folded node's value, and whose edges to it go.

    Nodes without edges stay. Two nodes that only point at each other remove each other. An edge to a removed node
    stays if that node was no leaf of the edge's source.
    """
    tables = Scratch(edges.sparkSession, "fold")
    state = tables.table(edges.dropna(subset=["src", "dst"]), "edges")
    nodes = tables.table(distinct_nodes(state).withColumn("value", F.lit(0).cast("bigint")), "nodes")
    for _ in rounds(max_rounds, "leaf folding"):
        single = state.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("to")).filter("n = 1")
        leaves = tables.table(single.join(nodes, "id").select("id", "to", "value"), "leaves")
        if not leaves.row_count:
            break
        before = (nodes, state, leaves)
        gained = leaves.groupBy(F.col("to").alias("id")).agg(F.sum(F.col("value") + 1).alias("gain"))
        dead = leaves.select("id")
        nodes = tables.table(
            nodes.join(dead, "id", "left_anti").join(gained, "id", "left").select("id", (F.col("value") + F.coalesce("gain", F.lit(0))).alias("value")), "nodes"
        )
        # edges from a leaf go, and those from the node it leads to back to it; edges of hubs are salted in both joins
        gone = dead.select(F.col("id").alias("src"), F.lit(True).alias("_gone"))
        cut = leaves.select(F.struct(F.col("to").alias("src"), F.col("id").alias("dst")).alias("_edge"), F.lit(True).alias("_cut"))
        rest = lookup(state, gone, "src", state.row_count, "dst").filter("_gone is null")
        rest = lookup(rest.withColumn("_edge", F.struct("src", "dst")), cut, "_edge", state.row_count, "dst").filter("_cut is null")
        state = tables.table(rest.select(*edges.columns), "edges")
        tables.drop(*before)
    return state, nodes

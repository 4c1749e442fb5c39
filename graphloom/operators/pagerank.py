"""Three PageRanks: absolute-delta push, its un-normalised library form, and power iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.balance import known_hot
from graphloom.graph import distinct_nodes
from graphloom.operators.bsp import rounds, send
from graphloom.scratch import Scratch

DAMPING = 0.85


def _shares(edges: DataFrame, tables: Scratch) -> DataFrame:
    """src, dst, share: the part of its rank that a node gives along its edges to dst; parallel edges add up."""
    ends = edges.select("src", "dst").dropna()
    pairs = ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    pairs = tables.table(pairs, "pairs")
    degree = pairs.groupBy("src").agg(F.sum("n").alias("degree")).withColumnRenamed("src", "id")
    shares = send(pairs, degree, pairs.row_count).select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))
    return tables.table(shares, "shares")


def _push(edges: DataFrame, start, first, delta: float | None, relative: bool, max_rounds: int | None) -> DataFrame:
    tables = Scratch(edges.sparkSession, "pagerank")
    shares = _shares(edges, tables)
    nodes = tables.table(distinct_nodes(edges.select("src", "dst").dropna()), "nodes")
    n = max(1, nodes.row_count)
    least = F.lit(float(delta) / n if relative else float(delta))
    # diff is what came last, and null for nodes that received nothing in the last round: those do not send again
    state = tables.table(nodes.select("id", F.lit(start(n)).alias("rank"), F.lit(first(n)).alias("diff")), "ranks")
    hot, m = known_hot(tables, shares, "src", shares.row_count)
    for _ in rounds(max_rounds, "PageRank"):
        sent = send(shares, state.filter(F.col("diff") > least).select("id", "diff"), m, hot=hot)
        merged = sent.groupBy(F.col("dst").alias("id")).agg((F.lit(DAMPING) * F.sum(F.col("diff") * F.col("share"))).alias("got"))
        step = state.join(merged, "id", "left").select("id", (F.col("rank") + F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("got").alias("diff"))
        step = tables.table(step, "ranks", n=F.count("diff"))
        tables.drop(state)
        state = step
        if not state.metrics["n"]:
            break
    return state.select("id", "rank")


def pagerank_delta(edges: DataFrame, delta: float = 0.001, relative: bool = False, max_rounds: int | None = None) -> DataFrame:
    """id, rank. Ranks start at 1/N and take a first push of 0.85/N; a node passes on what it received last while that
    exceeds delta. delta is absolute, so that graphs of 850 nodes or more stop at once under the default; with
    ``relative`` it is divided by N. Ranks do not add up to 1; what nodes without ways out receive ends there."""
    return _push(edges, lambda n: (1 + DAMPING) / n, lambda n: DAMPING / n, delta, relative, max_rounds)


def pagerank_library(edges: DataFrame, delta: float = 0.001, max_rounds: int | None = None) -> DataFrame:
    """id, rank, un-normalised: ranks start at 0.15 and sum up to about the number of nodes."""
    return _push(edges, lambda n: 1 - DAMPING, lambda n: 1 - DAMPING, delta, False, max_rounds)


def pagerank_power(edges: DataFrame, damping: float = DAMPING, tolerance: float = 0.001, max_rounds: int | None = None) -> DataFrame:
    """id, rank by power iteration from 1/N, until the largest relative change is below tolerance, after two rounds at
    the earliest. Mass of nodes without ways out is lost."""
    tables = Scratch(edges.sparkSession, "pagerank")
    shares = _shares(edges, tables)
    nodes = tables.table(distinct_nodes(edges.select("src", "dst").dropna()), "nodes")
    n = max(1, nodes.row_count)
    before = nodes
    state = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    hot, m = known_hot(tables, shares, "src", shares.row_count)
    for r in rounds(max_rounds, "PageRank"):
        got = send(shares, state, m, hot=hot).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        step = state.join(got, "id", "left").select("id", new.alias("rank"), (F.abs(new - F.col("rank")) / F.col("rank")).alias("change"))
        step = tables.table(step, "ranks", change=F.max("change"))
        tables.drop(before)
        before, state = step, step.select("id", "rank")
        if r > 0 and (step.metrics["change"] or 0.0) < tolerance:
            break
    return state

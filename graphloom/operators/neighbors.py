"""Communities that border one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.balance import lookup
from graphloom.operators.components import components
from graphloom.operators.louvain import MIN_PROGRESS, PROGRESS_COUNTER, louvain


def neighboring_communities(edges: DataFrame, min_progress: int = MIN_PROGRESS, progress_counter: int = PROGRESS_COUNTER) -> DataFrame:
    """src, src_community, dst, dst_community, component (of src), crosses: every edge, flagged where it leaves a community.

    Components are those of the largest id, communities those of the last level saved.
    """
    found = louvain(edges, min_progress=min_progress, progress_counter=progress_counter)
    if not found.levels:
        raise ValueError("no level of communities")
    info = found.labels().join(components(edges), "id")
    rows = edges.count()
    out = lookup(edges.select("src", "dst").dropna(), info.select(F.col("id").alias("src"), F.col("community").alias("src_community"), "component"), "src", rows, "dst", "inner")
    out = lookup(out, info.select(F.col("id").alias("dst"), F.col("community").alias("dst_community")), "dst", rows, "src", "inner")
    return out.select("src", "src_community", "dst", "dst_community", "component", (F.col("src_community") != F.col("dst_community")).alias("crosses"))

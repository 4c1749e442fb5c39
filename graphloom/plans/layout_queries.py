"""Queries of the text layouts, the readers' options and the message loops, over whole tables.

Every layout is one column, ``value``; the queries return what the sinks write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.functions.ipv4 import ipv4_to_long, long_to_ipv4
from graphloom.operators import betweenness, bsp, components, leaf, louvain, neighbors, pagerank
from graphloom.plans import derive
from graphloom.plans.graph_queries import _level0, edge_list
from graphloom.sinks import text
from graphloom.sources import community_text, edge_text


def sink_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of leaf compression."""
    return text.edge_lines(leaf.leaf_compression(graph.reverse_duplicated(edge_list(spark, sf_dir))))


def sink_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edge_list(spark, sf_dir)
    return text.component_lines(edges, components.components(edges), "\t")


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.pagerank_library(derive.user_sequence(spark, sf_dir), 0.01).select("id", F.round("rank", 6).alias("rank"))


def sink_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.vertex_lines(_ranks(spark, sf_dir), "rank", "|")


def sink_tab_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tab_vertex_lines(_ranks(spark, sf_dir), "rank")


def _high(spark: SparkSession, sf_dir: str) -> betweenness.HighBetweenness:
    return betweenness.high_betweenness(derive.user_sequence(spark, sf_dir), k=10, batch=6, most_pivots=10)


def sink_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _high(spark, sf_dir).betweenness
    return text.vertex_lines(found.select("id", F.round("betweenness", 4).alias("betweenness")), "betweenness")


def sink_betweenness_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.set_lines(_high(spark, sf_dir))


def sink_betweenness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the run but for its time, its rounds and the last change of the set."""
    stats = text.betweenness_stats(_high(spark, sf_dir), {}, 0.0)
    return text.stats_lines(spark, {k: v for k, v in stats.items() if k not in ("seconds", "rounds", "last_difference")})


def sink_level_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = _level0(spark, sf_dir)
    return level.vertices.select(text.state_line(level.vertices))


def sink_level_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.level_edge_lines(_level0(spark, sf_dir).edges)


def sink_q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modularity of every level kept."""
    return text.q_lines(spark, [round(lv.q, 6) for lv in louvain.louvain(edge_list(spark, sf_dir)).levels])


def sink_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.neighbor_lines(neighbors.neighboring_communities(edge_list(spark, sf_dir)))


def _both_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.merge_parallel(graph.reverse_duplicated(edge_list(spark, sf_dir)))
    return edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight"))


def sink_folded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that folding leaves, with the values of their source and their own."""
    left, nodes = leaf.leaf_folding(_both_text(spark, sf_dir).withColumnRenamed("weight", "value"))
    return text.configurable_edge_lines(left, nodes, ";", write_vertex_value=True, write_edge_value=True)


def sink_community_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = louvain.louvain(_both_text(spark, sf_dir), rules=louvain.TEXT).levels[0]
    return text.community_vertex_lines(level.vertices, level.edges)


def sink_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.dendrogram_lines(louvain.dendrogram([lv.vertices for lv in louvain.louvain(edge_list(spark, sf_dir)).levels]))


def edge_text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose value is text, the given default where there is none, in both directions."""
    rows = derive.read(spark, sf_dir, "edges_numeric").dropna(subset=["src", "dst"])
    fields = (F.col("src").cast("string"), F.col("dst").cast("string"), F.concat(F.lit("w"), F.col("weight").cast("string")))
    lines = rows.select(F.concat_ws(";", *fields).alias("value"))
    return edge_text.tokenized_edges(lines, ";", "text", default="none", reverse=True)


def edge_text_ignored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the column of values left aside and a number as default."""
    lines = edge_list(spark, sf_dir).select(F.concat_ws("::", *[F.col(c).cast("string") for c in ("src", "dst", "weight")]).alias("value"))
    return edge_text.tokenized_edges(lines, ":", default="7", ignore_value=True)


def edge_text_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between network addresses, made numbers by the reader's hook; a TAB between fields."""
    address = [long_to_ipv4(F.pmod(F.col(c) * 7919, F.lit(2**32))) for c in ("src", "dst")]
    lines = edge_list(spark, sf_dir).select(F.concat_ws("\t", *address).alias("value"))
    return edge_text.numeric_edges(lines, "\\t", convert=ipv4_to_long)


def names_as_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all names of the edge list, in the order in which they are first seen."""
    rows = derive.read(spark, sf_dir, "examples").select(F.col("line_id").alias("line"), F.col("c0").alias("src"), F.col("c1").alias("dst"))
    return edge_text.number_as_seen(rows)[0]


def community_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of communities read from their lines of text."""
    rows = derive.read(spark, sf_dir, "community_graph")
    lines = rows.select(F.concat_ws("\t", "id", F.coalesce("internalWeight", F.lit(0)).cast("string"), "edges").alias("value"))
    vertices, _ = community_text.community_states(community_text.community_rows(lines))
    return vertices.select("id", "communitySigmaTot", "internalWeight", "nodeWeight")


def _spread(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    edges = edge_list(spark, sf_dir)
    out = bsp.propagate(graph.distinct_nodes(edges), edges, F.col("value"), F.max, F.greatest("value", "msg"), F.col("id"), F.col("new") > F.col("value"), direction)
    return out.select("id", F.col("value").alias("component"))


def spread_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest id that a node reaches: labels travel against the edges."""
    return _spread(spark, sf_dir, "in")


def spread_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "either")


def node_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 nodes, always the same."""
    return bsp.take_sample(graph.distinct_nodes(edge_list(spark, sf_dir)), 100, 5)


QUERIES = {
    f.__name__: f
    for f in (
        sink_edges, sink_components, sink_ranks, sink_tab_vertices, sink_betweenness, sink_betweenness_set, sink_betweenness_stats, sink_level_vertices, sink_level_edges, sink_q_values,
        sink_neighbors, sink_folded_edges, sink_community_vertices, sink_dendrogram, edge_text_values, edge_text_ignored_values, edge_text_addresses, names_as_seen,
        community_lines, spread_in, spread_either, node_sample,
    )
}

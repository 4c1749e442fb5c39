"""Queries of the graph operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.functions.ipv4 import ipv4_to_long, long_to_ipv4
from graphloom.operators import betweenness, bsp, components, leaf, louvain, neighbors, pagerank
from graphloom.plans import derive
from graphloom.scratch import Scratch
from graphloom.sources import community_text, edge_text


def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(derive.read(spark, sf_dir, "edges_numeric"), weight="weight")


def _lines(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    return edge_list(spark, sf_dir).select(F.concat_ws(sep, *[F.col(c).cast("string") for c in ("src", "dst", "weight")]).alias("value"))


def edge_text_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_text.strict_edges(_lines(spark, sf_dir, " | "), r"\|")


def edge_text_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_text.numeric_edges(_lines(spark, sf_dir, "\x01"), "\\x01")


def edge_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_text.tokenized_edges(_lines(spark, sf_dir, ";,"), ",;", reverse=True)


def reverse_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_duplicated(edge_list(spark, sf_dir))


def merge_parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_parallel(edge_list(spark, sf_dir))


def distinct_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distinct_nodes(edge_list(spark, sf_dir))


def node_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of all names of the edge list, in their order."""
    names = derive.read(spark, sf_dir, "examples").select(F.col("c0").alias("src"), F.col("c1").alias("dst")).dropna()
    return graph.node_dictionary(names)


def encoded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge list with numbers for names."""
    edges = graph.edges_of(derive.read(spark, sf_dir, "examples"), "c0", "c1", "c2")
    return graph.encode(edges, graph.node_dictionary(edges), edges.count())


def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree(edge_list(spark, sf_dir))


def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weighted_degree(edge_list(spark, sf_dir))


def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nodes with more than one edge out."""
    edges = edge_list(spark, sf_dir)
    return graph.subgraph(edges, graph.out_degree(edges).filter("degree > 1"), edges.count())


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge with the degree of its source, by the message kernel."""
    edges = edge_list(spark, sf_dir)
    return bsp.send(edges, graph.out_degree(edges), edges.count()).select("src", "dst", "weight", "degree")


def top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nodes of the highest weighted degree."""
    return bsp.top_k(graph.weighted_degree(edge_list(spark, sf_dir)), 10, "weight")


def community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community_text.community_edges(derive.read(spark, sf_dir, "community_graph"))


def community_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, _ = community_text.community_states(derive.read(spark, sf_dir, "community_graph"))
    return vertices.select("id", "communitySigmaTot", "internalWeight", "nodeWeight")


def ipv4_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "events").select("event_id", ((F.col("user_id") * 7919 + F.col("event_id") * 104729) % 2**32).alias("number"))
    rows = rows.withColumn("address", long_to_ipv4("number"))
    return rows.select("event_id", "address", ipv4_to_long("address").alias("back"))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_parallel(derive.nation_trade(spark, sf_dir))


def part_next_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree(derive.part_next(spark, sf_dir))


def user_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_parallel(derive.user_sequence(spark, sf_dir))


def wcc_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(edge_list(spark, sf_dir), "max")


def wcc_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(edge_list(spark, sf_dir), "min")


def wcc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components_text(edge_list(spark, sf_dir), bidirectional=True)


def wcc_text_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest label by text that reaches a node along edges."""
    return components.components_text(edge_list(spark, sf_dir))


def leaf_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaf.leaf_compression(edge_list(spark, sf_dir))


def leaf_compression_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaf.leaf_compression(graph.reverse_duplicated(edge_list(spark, sf_dir)))


def leaf_compression_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core of the users in the order of their events, which is not empty."""
    return leaf.leaf_compression(derive.user_sequence(spark, sf_dir)).select("src", "dst", F.col("weight").cast("int").alias("weight"))


def leaf_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = graph.merge_parallel(graph.reverse_duplicated(edge_list(spark, sf_dir)))
    return leaf.leaf_folding(both)[1]


def _rounded(df: DataFrame, value: str) -> DataFrame:
    return df.select("id", F.round(value, 6).alias(value))


def pagerank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pagerank.pagerank_delta(derive.user_sequence(spark, sf_dir)), "rank")


def pagerank_delta_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the delta a share of 1/N, which is not met at once on graphs of any size."""
    return _rounded(pagerank.pagerank_delta(derive.user_sequence(spark, sf_dir), 0.01, relative=True), "rank")


def pagerank_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pagerank.pagerank_library(derive.user_sequence(spark, sf_dir), 0.01), "rank")


def pagerank_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pagerank.pagerank_power(derive.user_sequence(spark, sf_dir)), "rank")


_STATE = ("id", "community", "communitySigmaTot", "internalWeight", "nodeWeight")


def louvain_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return louvain.initial(edge_list(spark, sf_dir))[0].select(*_STATE)


def _start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, louvain.Hubs]:
    tables = Scratch(spark, "start")
    v, e = (tables.table(t) for t in louvain.initial(edge_list(spark, sf_dir)))
    return v, e, louvain.Hubs.of(v, e, tables, louvain.NUMERIC)


def louvain_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, hubs = _start(spark, sf_dir)
    return louvain.community_messages(v, e, hubs=hubs).select("id", "c", "cSigma", "w")


def louvain_best_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, hubs = _start(spark, sf_dir)
    return louvain.best_moves(v, louvain.community_messages(v, e, hubs=hubs), louvain.total_weight(v), hubs=hubs).select("id", "best")


def louvain_one_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, hubs = _start(spark, sf_dir)
    return louvain.cycle(v, e, louvain.total_weight(v), True, hubs=hubs).select(*_STATE, "changed")


def _level0(spark: SparkSession, sf_dir: str) -> louvain.Level:
    """The first level by the stop rule of the operator, as in louvain_labels."""
    return louvain.one_level(*louvain.initial(edge_list(spark, sf_dir)), Scratch(spark, "level"))


def louvain_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communities of the first level."""
    return _level0(spark, sf_dir).vertices.select(*_STATE)


def louvain_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modularity of the first level."""
    level = _level0(spark, sf_dir)
    return louvain.modularity(level.vertices, level.edges, louvain.total_weight(level.vertices), hubs=level.hubs).select(F.round("q", 9).alias("q"))


def louvain_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communities of the first level as vertices."""
    level = _level0(spark, sf_dir)
    return louvain.compress(level.vertices, level.edges)[0].select(*_STATE)


def louvain_compress_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = _level0(spark, sf_dir)
    return louvain.compress(level.vertices, level.edges)[1]


def louvain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return louvain.louvain(edge_list(spark, sf_dir)).labels()


def louvain_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a first vertex and level that it has a community on."""
    table = louvain.dendrogram([lv.vertices for lv in louvain.louvain(edge_list(spark, sf_dir)).levels])
    levels = [F.struct(F.lit(i).alias("level"), F.col(c).alias("community")) for i, c in enumerate(table.columns[1:])]
    return table.select("id", F.inline(F.array(*levels))).filter(F.col("community").isNotNull())


def louvain_level_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modularity of every level kept."""
    return louvain.louvain(edge_list(spark, sf_dir)).q_values(spark).select("level", F.round("q", 9).alias("q"))


def louvain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by the text rules."""
    edges = graph.merge_parallel(graph.reverse_duplicated(edge_list(spark, sf_dir)))
    text = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    return louvain.louvain(text, rules=louvain.TEXT).labels()


def community_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the community graph brought together by community (the smallest target, or the row itself)."""
    edges = community_text.community_edges(derive.read(spark, sf_dir, "community_graph"))
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("edges"), F.min("dst").alias("community"))
    rows = lists.select("id", "community", F.lit(1).cast("bigint").alias("internalWeight"), "edges")
    return louvain.compress_community_rows(rows)


def neighboring_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighboring_communities(edge_list(spark, sf_dir))


def betweenness_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(betweenness.betweenness(derive.user_sequence(spark, sf_dir)), "betweenness")


def betweenness_one_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one predecessor kept of several."""
    return _rounded(betweenness.betweenness(derive.user_sequence(spark, sf_dir), ties="one"), "betweenness")


def betweenness_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges have lengths: their number less one, at most two; a length of zero counts as one."""
    edges = graph.merge_parallel(derive.user_sequence(spark, sf_dir)).withColumn("weight", F.least(F.col("weight"), F.lit(3)) - 1)
    return _rounded(betweenness.betweenness(edges), "betweenness")


def hbse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest of twelve pivots or more."""
    return _rounded(betweenness.high_betweenness(derive.user_sequence(spark, sf_dir), k=10, batch=6, most_pivots=10).top, "betweenness")


QUERIES = {
    f.__name__: f
    for f in (
        edge_list, edge_text_strict, edge_text_numeric, edge_text_tokens, reverse_duplicate_edges, merge_parallel_edges, distinct_nodes, node_dictionary, encoded_edges,
        out_degree, weighted_degree, subgraph, triplets, top_degree, community_edges, community_states, ipv4_round_trip, nation_trade, part_next_degree, user_sequence,
        wcc_max, wcc_min, wcc_text, wcc_text_directed, leaf_compression, leaf_compression_both, leaf_compression_sequence, leaf_fold, pagerank_delta,
        pagerank_delta_relative, pagerank_library, pagerank_power,
        louvain_initial, louvain_messages, louvain_best_move, louvain_one_cycle, louvain_level0, louvain_modularity, louvain_compress, louvain_compress_edges,
        louvain_labels, louvain_dendrogram, louvain_level_q, louvain_text, community_compression, neighboring_communities, betweenness_exact, betweenness_one_path, betweenness_lengths,
        hbse_topk,
    )
}

"""The text layouts of the analytics. Each maker returns one column, ``value``; :func:`write` writes it."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.balance import lookup
from graphloom.operators.betweenness import HighBetweenness
from graphloom.operators.louvain import Level


def run_folder(base: str, prefix: str = "") -> str:
    """A folder for one run, named by the milliseconds of now."""
    return f"{prefix}{base.rstrip('/')}/{int(time.time() * 1000)}"


def write(lines: DataFrame, path: str, single: bool = False) -> None:
    """Write lines; ``single`` is meant for results of a few rows."""
    (lines.coalesce(1) if single else lines).write.text(path)


def _line(delimiter: str, *columns: Column | str) -> Column:
    return F.concat_ws(delimiter, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]).alias("value")


def edge_lines(edges: DataFrame, delimiter: str = ",") -> DataFrame:
    """src, dst of every edge left."""
    return edges.select(_line(delimiter, "src", "dst"))


def component_lines(edges: DataFrame, labels: DataFrame, delimiter: str = ",") -> DataFrame:
    """src, dst and the source's component of every edge."""
    met = lookup(edges, labels.select(F.col("id").alias("src"), "component"), "src", edges.count(), "dst", "inner")
    return met.select(_line(delimiter, "src", "dst", "component"))


def vertex_lines(values: DataFrame, value: str, delimiter: str = ",") -> DataFrame:
    """id and value of every vertex."""
    return values.select(_line(delimiter, "id", value))


def write_high_betweenness(found: HighBetweenness, path: str, delimiter: str = ",") -> None:
    """All vertices under path, and the top set beside it."""
    write(vertex_lines(found.betweenness, "betweenness", delimiter), path)
    write(vertex_lines(found.top, "betweenness", delimiter), f"{path}highBetweennessSetData", single=True)


def betweenness_stats(found: HighBetweenness, settings: dict, seconds: float) -> dict:
    """The figures of a run: settings, pivots, cycles, rounds and seconds."""
    n = found.betweenness.count()
    return {
        **(found.settings or {}), **settings, "pivots_selected": found.pivots, "pivots_percent": 100 * found.pivots / max(1, n), "cycles": found.cycles,
        "rounds": found.rounds, "last_difference": found.last_difference, "seconds": seconds,
    }


def stats_lines(spark: SparkSession, stats: dict) -> DataFrame:
    """name,value of every figure."""
    return spark.createDataFrame([(f"{k},{v}",) for k, v in stats.items()], "value string")


def set_lines(found: HighBetweenness) -> DataFrame:
    """The ids of the top set."""
    return found.top.select(F.col("id").cast("string").alias("value"))


def write_set_and_stats(found: HighBetweenness, stats: dict, path: str) -> None:
    """final_set.csv with the ids of the top set, stats.csv with the figures."""
    spark = found.top.sparkSession
    write(set_lines(found), f"{path}/final_set.csv", single=True)
    write(stats_lines(spark, stats), f"{path}/stats.csv", single=True)


def state_line(columns: DataFrame) -> Column:
    """A vertex and its state, as (id,{name:...,community:...,...})."""
    fields = ("name", "community", "communityName", "communitySigmaTot", "internalWeight", "nodeWeight")
    pairs = [F.concat(F.lit(f"{c}:"), F.coalesce(columns[c].cast("string"), F.lit("null"))) for c in fields]
    return F.concat(F.lit("("), columns["id"].cast("string"), F.lit(",{"), F.concat_ws(",", *pairs), F.lit("})")).alias("value")


def level_edge_lines(edges: DataFrame) -> DataFrame:
    """Edge(src,dst,weight) of every edge between communities."""
    return edges.select(F.concat(F.lit("Edge("), F.concat_ws(",", *[F.col(c).cast("string") for c in ("src", "dst", "weight")]), F.lit(")")).alias("value"))


def q_lines(spark: SparkSession, q_values: list[float]) -> DataFrame:
    """(level,modularity) of the levels so far."""
    return spark.createDataFrame([(f"({i},{q})",) for i, q in enumerate(q_values)], "value string")


def write_level(index: int, level: Level, path: str, q_values: list[float]) -> None:
    """level_<i>_vertices, level_<i>_edges and the modularities so far, qvalues_<i>."""
    write(level.vertices.select(state_line(level.vertices)), f"{path}/level_{index}_vertices")
    write(level_edge_lines(level.edges), f"{path}/level_{index}_edges")
    write(q_lines(level.vertices.sparkSession, q_values), f"{path}/qvalues_{index}", single=True)


def neighbor_lines(rows: DataFrame, delimiter: str = ",", split: str = ":") -> DataFrame:
    """src:community, dst:community, component and whether the edge crosses communities."""
    src, dst = (F.concat_ws(split, F.col(e).cast("string"), F.col(f"{e}_community").cast("string")) for e in ("src", "dst"))
    return rows.select(_line(delimiter, src, dst, "component", "crosses"))


def configurable_edge_lines(edges: DataFrame, vertices: DataFrame | None = None, delimiter: str = ",", write_vertex_value: bool = False, write_edge_value: bool = False) -> DataFrame:
    """src, dst[, value of the source vertex (column value)][, value of the edge (column value or weight)]."""
    own = "value" if "value" in edges.columns else "weight"
    out = edges.withColumnRenamed(own, "_edge") if own in edges.columns else edges.withColumn("_edge", F.lit(""))
    if write_vertex_value:
        out = lookup(out, vertices.select(F.col("id").alias("src"), F.col("value").alias("_vertex")), "src", edges.count(), "dst", "inner")
    columns = ["src", "dst", *["_vertex"] * write_vertex_value, *["_edge"] * write_edge_value]
    return out.select(_line(delimiter, *columns))


def tab_vertex_lines(values: DataFrame, value: str) -> DataFrame:
    """id TAB value."""
    return vertex_lines(values, value, "\t")


def community_vertex_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id TAB community TAB internalWeight TAB target:weight,... with targets in order; without edges there is no last field.

    The layout puts all edges of a vertex on one line, so that line, and the task that makes it, is as large as they are.
    """
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["dst"].cast("string"), x["weight"].cast("string"))), ",")
    return vertices.join(lists, "id", "left").select(F.concat_ws("\t", F.col("id").cast("string"), F.col("community").cast("string"), F.col("internalWeight").cast("string"), text).alias("value"))


def dendrogram_lines(table: DataFrame, delimiter: str = "\t") -> DataFrame:
    """id, c0, c1, ...; rows end where a community has no next one."""
    return table.select(F.concat_ws(delimiter, *[F.col(c).cast("string") for c in table.columns]).alias("value"))

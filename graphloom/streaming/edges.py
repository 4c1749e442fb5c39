"""Edge lists that keep arriving: the sources' parsers and the merging of parallel edges over streams.

The parsers are narrow and work on streams as they are. Running sums keep state by edge; a watermark on an event time
bounds it where windows are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.edge_text import tokenized_edges


def stream_lines(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """The lines of text files as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder)


def stream_edges(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    return tokenized_edges(lines, delimiter, "long").withColumnRenamed("value", "weight")


def running_weights(edges: DataFrame) -> DataFrame:
    """src, dst, weight, n so far; write it in update or complete mode."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def windowed_weights(edges: DataFrame, at: str = "seen_at", size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, src, dst, weight, n by windows of event time; rows later than ``late`` are left out, and their state goes."""
    window = F.window(at, size)
    out = edges.withWatermark(at, late).groupBy(window, "src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "src", "dst", "weight", "n")

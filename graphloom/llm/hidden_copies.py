"""Copies hidden by formatting: rows whose two names agree in plain form, in either order.

Progressive refinement: rows are first put into classes by invariants that formatting and order cannot change (the
length and a letter histogram of the plain text), then only rows in classes of several members are compared by the
costlier ordered pair of names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.balance import LEAST_HOT_ROWS, hot_threshold, lookup
from graphloom.functions.names import plain_form
from graphloom.scratch import Scratch

#: Characters whose counts make up the histogram; common in names, and found by byte search.
HISTOGRAM = "aeinor1234"


def invariant(parts: Sequence[Column]) -> Column:
    """A bigint that is the same for all orders of the plain texts: their total length and a letter histogram."""
    text = F.concat(*parts)
    size = F.octet_length(text)
    packed = F.least(size, F.lit(8191)).cast("bigint")
    for c in HISTOGRAM:
        packed = F.shiftleft(packed, 5) + F.least(size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))), F.lit(31))
    return packed


def _rows(df: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    parts = [plain_form(F.col(c)).alias(f"_f{i}") for i, c in enumerate(fields)]
    rows = df.select(F.col(row_id).alias("id"), *parts)
    for i in range(len(fields)):
        rows = rows.filter((F.col(f"_f{i}") != "") & F.col(f"_f{i}").isNotNull())
    return rows.withColumn("k0", invariant([F.col(f"_f{i}") for i in range(len(fields))]))


def _key(fields: Sequence[str]) -> Column:
    """The costlier key: the plain texts in order, as one text. Plain texts hold no blank."""
    return F.array_join(F.array_sort(F.array(*[F.col(f"_f{i}") for i in range(len(fields))])), " ")


def _classes(df: DataFrame, row_id: str, fields: Sequence[str], label: str, **bounds: int) -> tuple[DataFrame, DataFrame | None, int]:
    """The first refinement: (rows of small classes, rows of large ones if there are any, number of rows).

    Small classes are brought together once; ``key`` is made for the rows of classes of several members only and null
    for the others. Rows of large classes, above :func:`graphloom.balance.hot_threshold`, stay where they are and all
    have their key; there are at most rows / threshold such classes.
    """
    tables = Scratch(df.sparkSession, label)
    rows = _rows(df, row_id, fields)
    seen = Observation()
    counts = rows.groupBy("k0").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    large = tables.table(counts.filter(F.col("n") > bounds.get("least", LEAST_HOT_ROWS)), "large", most=F.max("n"))
    total = seen.get["total"]
    limit = hot_threshold(total, **bounds)
    hot = large.filter(F.col("n") > limit).select("k0") if (large.metrics["most"] or 0) > limit else None
    small = rows if hot is None else rows.join(F.broadcast(hot), "k0", "left_anti")
    inside = small.withColumn("n0", F.count(F.lit(1)).over(W.partitionBy("k0"))).withColumn("key", F.when(F.col("n0") > 1, _key(fields)))
    return inside, None if hot is None else rows.join(F.broadcast(hot), "k0", "left_semi").select("id", _key(fields).alias("key")), total


def copies(df: DataFrame, row_id: str = "line_id", fields: Sequence[str] = ("c0", "c1"), **bounds: int) -> DataFrame:
    """keep_id, copy_id: for all rows but the one with the smallest id of each group of copies.

    Rows with a null field, or one without any letter or digit, are left out. row_id must be unique and not null. An
    empty table gives an empty result; further columns do not matter. One narrow shuffle of the rows of small classes;
    large classes are grouped with map-side pre-aggregation and joined with salts instead, so no task ever holds one.
    """
    inside, hot, total = _classes(df, row_id, fields, "copies", **bounds)
    several = inside.filter("n0 > 1").withColumn("keep_id", F.min("id").over(W.partitionBy("k0", "key")))
    out = several.filter("id > keep_id").select("keep_id", F.col("id").alias("copy_id"))
    if hot is not None:
        keepers = hot.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        more = lookup(hot, keepers, "key", total, "id", "inner", **bounds).filter("id > keep_id")
        out = out.unionByName(more.select("keep_id", F.col("id").alias("copy_id")))
    return out


def collapsed(df: DataFrame, row_id: str = "line_id", fields: Sequence[str] = ("c0", "c1"), **bounds: int) -> DataFrame:
    """One row per record: keep_id, n_copies (the rows of the group, itself included), through the same classes as
    :func:`copies`: a class of one member is a record without its key being made. No shuffle after that of the classes,
    as the keys of a class lie together; large classes are pre-aggregated."""
    inside, hot, _ = _classes(df, row_id, fields, "collapsed", **bounds)
    one = [F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")]
    out = inside.groupBy("k0", "key").agg(*one).select("keep_id", "n_copies")
    return out if hot is None else out.unionByName(hot.groupBy("key").agg(*one).select("keep_id", "n_copies"))

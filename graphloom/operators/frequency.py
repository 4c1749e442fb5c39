"""Per-key results under extreme skew, by value-frequency compression.

Rows are grouped by key *and value* first. That grouping is pre-aggregated on the map side and its groups spread over
all tasks, however many rows one key holds. Counts, exact distinct counts, modes, last rows and percentiles then come
from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.balance import lookup
from graphloom.functions.names import plain_form
from graphloom.scratch import Scratch


def compress(df: DataFrame, keys: Sequence[str], value: str, **extra: Column) -> DataFrame:
    """One row per key and value with the weight ``n`` (and further aggregates of the rows). Nulls form own groups."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in extra.items()))


def names_report(df: DataFrame, name: str = "c0", order: str = "seen_at", tie: str = "line_id") -> DataFrame:
    """For each plain form of ``name``: <tie> of its row with the latest ``order`` (null is earliest; the largest ``tie``
    among equals), n rows, n_spellings different spellings, and the most frequent spelling (the smallest among equals).

    Rows whose name is null or has no letter or digit are left out; an empty table gives none. The value grouped by first
    is the spelling: its weight and its last row are all that is left of a hot name's rows, and the plain form is taken
    once a spelling, not once a row. Both groupings keep one maximum a group and never hold a group's rows.
    """
    rows = df.select(F.col(name).alias("spelling"), F.struct(F.col(order).alias("_at"), F.col(tie).alias("_id")).alias("_last"))
    weighted = compress(rows.filter(F.col("spelling").isNotNull()), [], "spelling", last=F.max("_last"))
    named = weighted.select(plain_form("spelling").alias("name"), "spelling", "last", "n").filter(F.col("name") != "")
    often = F.min(F.struct((-F.col("n")).alias("_n"), "spelling"))
    out = named.groupBy("name").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_spellings"), often.alias("often"))
    return out.select("name", F.col("last._id").alias(tie), "n", "n_spellings", F.col("often.spelling").alias("spelling"))


def last_by_plain_name(df: DataFrame, name: str = "c0", order: str = "seen_at", tie: str = "line_id") -> DataFrame:
    """name, <tie>: the last row of each plain form, as in :func:`names_report`."""
    return names_report(df, name, order, tie).select("name", tie)


def key_profile(df: DataFrame, key: Column, value: str) -> DataFrame:
    """Per key: n rows, n_values distinct non-null values, mode (the smallest among equals) and its mode_n.

    value is of a whole-number type, of which all numbers are allowed. Null keys are left out, null values count only in
    n. All from the weighted values.
    """
    weighted = compress(df.select(key.alias("key"), F.col(value).alias("value")).filter(F.col("key").isNotNull()), ["key"], "value")
    there = F.col("value").isNotNull()
    best = F.max(F.when(there, F.struct(F.col("n").alias("n"), F.bitwise_not("value").alias("v"))))  # turned by bits, as the least number has no negative
    return weighted.groupBy("key").agg(
        F.sum("n").alias("n"), F.count(F.when(there, 1)).alias("n_values"), best.alias("_best")
    ).select("key", "n", "n_values", F.bitwise_not("_best.v").alias("mode"), F.col("_best.n").alias("mode_n"))


def key_percentile(df: DataFrame, key: Column, value: str, q: float, bits: int = 16) -> DataFrame:
    """The exact discrete percentile of a bigint per key: the least value that at least q of the key's values do not exceed.

    Radix descent: the weighted values are counted per key and leading digit (2**bits buckets, so no window ever holds
    more rows), the bucket of the wanted rank is chosen, and only its values go on to the next digit; buckets with many
    values are salted. 64 / bits rounds.
    Null keys and values are left out.
    """
    spark = df.sparkSession
    tables = Scratch(spark, "percentile")
    rows = df.select(key.alias("key"), F.col(value).cast("bigint").alias("value")).dropna()
    # with the sign bit turned, the order of the digits is that of the values
    left = tables.table(compress(rows, ["key"], "value").withColumn("u", F.col("value").bitwiseXOR(F.lit(-(2**63)))), "weighted")
    want = left.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * F.lit(q)).cast("bigint")).alias("rank"))
    want = tables.table(want, "ranks")
    for shift in range(64 - bits, -1, -bits):
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(2**bits - 1))
        counts = left.withColumn("digit", digit).groupBy("key", "digit").agg(F.sum("n").alias("m"))
        run = F.sum("m").over(W.partitionBy("key").orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
        chosen = counts.withColumn("upto", run).join(want, "key").filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
        chosen = tables.table(chosen.select("key", "digit", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank")), "chosen")
        place = F.struct("key", "digit").alias("place")
        keep = lookup(left.withColumn("digit", digit).select("key", "value", "n", "u", place), chosen.select(place), "place", left.row_count, "value", "left_semi")
        left = tables.table(keep.drop("place"), "left")
        want = chosen.select("key", "rank")
    return left.select("key", F.col("value").alias("percentile"))

"""Joins and groupings that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No more than this many hot keys are broadcast, at any size of the data.
MOST_HOT_KEYS = 200_000
#: A key with fewer rows than this is never treated as hot.
LEAST_HOT_ROWS = 50_000


def hot_threshold(rows: int, most: int = MOST_HOT_KEYS, least: int = LEAST_HOT_ROWS) -> int:
    """Rows above which a key is hot. At most rows / threshold <= most keys can be hot, which bounds the broadcast."""
    return max(least, -(-rows // most))


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int, **bounds: int) -> DataFrame:
    """The keys with more rows than the threshold, with ``_parts``, the number of parts each is to be split into."""
    limit = hot_threshold(rows, **bounds)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    )


def known_hot(tables, df: DataFrame, key: str, rows: int) -> tuple[DataFrame | None, int]:
    """The hot keys of a table that is joined by ``key`` again and again, written once, and the number of rows to give to
    :func:`lookup`: 0 if there are none."""
    if rows <= hot_threshold(rows):
        return None, 0
    found = tables.table(hot_keys(df.filter(F.col(key).isNotNull()), [key], rows), "hot")
    return (found, rows) if found.row_count else (None, 0)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, spread: str, how: str = "left", hot: DataFrame | None = None, **bounds: int) -> DataFrame:
    """Join left (many rows a key) to right (one row a key) on the column ``key`` with no task holding a hot key whole.

    Rows of a hot key are spread over salts by the hash of the column ``spread``; only the matching rows of right are
    repeated, once for each salt. Hot keys are found by a pre-aggregated count and broadcast, which
    :func:`hot_threshold` bounds; ``hot`` gives them where they are known, or a few more. Null keys match nothing. The key columns must not be null in right.
    """
    if rows <= hot_threshold(rows, **bounds):  # no key can be hot
        return left.join(right, key, how)
    hot = hot_keys(left.filter(F.col(key).isNotNull()), [key], rows, **bounds) if hot is None else hot
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_parts"))).otherwise(F.lit(0)).cast("int")
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts")
    copies = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return salted.join(copies, [key, "_salt"], how).drop("_salt")

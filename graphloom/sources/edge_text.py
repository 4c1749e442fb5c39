"""Delimited text as edges. Reading, parsing and checks are one narrow pass of built-in functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.delimiters import decode


def read_lines(spark: SparkSession, path: str | list[str], parallelism: int | None = None) -> DataFrame:
    """The lines of text files; parallelism asks for that many partitions."""
    lines = spark.read.text(path)
    return lines.repartition(parallelism) if parallelism and parallelism > 0 else lines


def _broken(what: str) -> Column:
    return F.raise_error(F.concat(F.lit(what + ": "), F.col("value")))


def strict_edges(lines: DataFrame, delimiter: str = ",", regex: bool = True) -> DataFrame:
    """src, dst (text), weight from lines (column value) of exactly two or three fields; others are an error.

    The delimiter is a pattern (or taken literally with regex=False; codes like ``\\x01`` are). Fields are trimmed,
    empty ones at the end are dropped. A missing weight is 1; one that is no 64-bit integer is an error.
    """
    literal = not regex or delimiter.startswith("\\x") or delimiter == "\\t"
    pattern = re.escape(decode(delimiter)) if literal else delimiter
    fields = F.transform(F.split("value", pattern), lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    # as many fields as there are up to the last one that is not empty
    count = F.aggregate(F.transform(fields, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    rows = lines.withColumn("_f", fields).withColumn("_n", count)
    good = F.col("_n").isin(2, 3)
    weight = F.when(F.col("_n") == 2, F.lit(1).cast("bigint")).otherwise(F.expr("try_cast(_f[2] as bigint)"))
    return rows.select(
        F.when(good, F.col("_f")[0]).otherwise(_broken("invalid input line")).alias("src"),
        F.when(good, F.col("_f")[1]).otherwise(_broken("invalid input line")).alias("dst"),
        F.when(~good, _broken("invalid input line").cast("bigint")).otherwise(F.coalesce(weight, _broken("invalid weight in line").cast("bigint"))).alias("weight"),
    )


def numeric_edges(lines: DataFrame, delimiter: str = ",", convert: Callable[[Column], Column] | None = None) -> DataFrame:
    """As :func:`strict_edges` with ids made numbers by ``convert`` (default: a cast; an id it turns into null is an error)."""
    make = convert or (lambda c: c.try_cast("bigint"))
    edges = strict_edges(lines, delimiter)

    def number(c: str) -> Column:
        return F.coalesce(make(F.col(c)), F.raise_error(F.concat(F.lit("invalid id: "), F.col(c))).cast("bigint"))

    return edges.select(number("src").alias("src"), number("dst").alias("dst"), "weight")


def tokenized_edges(
    lines: DataFrame, delimiter: str = ",", value: str = "long", default: str | None = None, ignore_value: bool = False, reverse: bool = False,
) -> DataFrame:
    """src, dst (text), value from lines split at *any* character of the delimiter; runs of them count once.

    Fewer than two fields are an error, further ones than the third are ignored. value is "long" (default 1; anything
    but a 64-bit integer is an error) or "text" (default empty). ``reverse`` adds each edge turned round.
    """
    chars = "".join(f"\\x{{{ord(c):x}}}" for c in decode(delimiter))
    fields = F.filter(F.split("value", f"[{chars}]"), lambda x: x != "")
    rows = lines.withColumn("_f", fields)
    enough = F.size("_f") >= 2
    third = F.lit(None).cast("string") if ignore_value else F.when(F.size("_f") >= 3, F.col("_f")[2])
    if value == "long":
        got = F.when(third.isNull(), F.lit(int(default if default is not None else 1)).cast("bigint")).otherwise(
            F.coalesce(third.try_cast("bigint"), _broken("the edge value is no integer").cast("bigint"))
        )
    else:
        got = F.coalesce(third, F.lit(default or ""))
    out = rows.select(
        F.when(enough, F.col("_f")[0]).otherwise(_broken("too few fields")).alias("src"), F.when(enough, F.col("_f")[1]).otherwise(_broken("too few fields")).alias("dst"),
        F.when(enough, got).otherwise(_broken("too few fields").cast("bigint" if value == "long" else "string")).alias("value"),
    )
    if reverse:
        out = out.select(F.inline(F.array(F.struct("src", "dst", "value"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("value").alias("value")))))
    return out


def first_seen_dictionary(spark: SparkSession, path: str, delimiter: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(dictionary (name, id), edges (src, dst)) of a file of two fields or more a line: names are numbered from 0 in the
    order in which they are first seen, the source before the target. Lines with fewer fields are left out.

    The order of lines is that of the file's blocks, numbered by partition; the dense numbers come from ranks over
    range partitions.
    """
    fields = F.split("value", re.escape(delimiter))
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).withColumn("f", fields).filter(F.size("f") >= 2)
    return number_as_seen(lines.select("line", F.trim(F.col("f")[0]).alias("src"), F.trim(F.col("f")[1]).alias("dst")))


def number_as_seen(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary (name, id), edges (src, dst)) of rows (line, src, dst) in the order of ``line``; null ends have no number."""
    from graphloom.graph import dense_ranks
    from graphloom.scratch import Scratch

    tables = Scratch(rows.sparkSession, "first-seen")
    rows = tables.table(rows, "lines")
    ends = rows.select(F.inline(F.array(F.struct(F.col("src").alias("name"), (F.col("line") * 2).alias("at")), F.struct(F.col("dst").alias("name"), (F.col("line") * 2 + 1).alias("at")))))
    ranks = dense_ranks(ends.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min("at").alias("at")), ["at"], tables)
    return ranks.select("name", "id"), rows.select("src", "dst")

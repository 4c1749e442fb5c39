"""Rounds of messages along edges, as joins and pre-aggregated groupings.

The kernel under message-passing analytics: state by vertex, messages along the edges of vertices that changed last,
one merged message a vertex, a new state. The loop runs on the driver; each round is one plan, written to scratch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.balance import known_hot, lookup
from graphloom.scratch import Scratch


def rounds(most: int | None, what: str) -> Iterator[int]:
    """0, 1, ... for a loop that leaves when it is done; an error if it is not after ``most`` rounds, where that is given."""
    for r in count():
        if r == most:
            raise RuntimeError(f"{what} has not ended after {most} rounds")
        yield r


def send(edges: DataFrame, state: DataFrame, rows: int, along: str = "out", hot: DataFrame | None = None) -> DataFrame:
    """Edges with the state columns of the sending end: its source (out) or its target (in). Edges whose sender is not
    in state send nothing; senders with many edges are salted; ``hot`` are
    those with their parts, where they are known (:func:`graphloom.balance.known_hot`)."""
    key, other = ("src", "dst") if along == "out" else ("dst", "src")
    return lookup(edges, state.withColumnRenamed("id", key), key, rows, other, "inner", hot=hot)


def propagate(
    vertices: DataFrame, edges: DataFrame, message: Column, merge, apply: Column, start: Column, active: Column,
    direction: str = "out", max_rounds: int | None = None, aggregates: dict[str, Column] | None = None, halt: Callable[[int, dict], bool] | None = None,
) -> DataFrame:
    """A general fixpoint over a graph.

    vertices: id and any state columns (kept); ``start`` gives the initial ``value``. Each round, vertices that changed
    last send ``message`` (an expression over value, weight) along ``direction`` (out, in, either); ``merge`` is an
    aggregate function of the column of messages; ``apply`` is the new value from value and msg; ``active`` says, from
    value and new, whether the vertex sends next round. Ends when no vertex is active; an error if some still are after max_rounds, where
    that is given. ``aggregates`` are aggregate expressions over a round's new state, handed with the round's number to
    ``halt`` on the driver, which may end the loop.
    """
    tables = Scratch(edges.sparkSession, "propagate")
    edges = tables.table(edges, "edges")
    state = tables.table(vertices.withColumn("value", start).withColumn("active", F.lit(True)), "state")
    ways = ("out", "in") if direction == "either" else (direction,)
    hubs = {way: known_hot(tables, edges, "src" if way == "out" else "dst", edges.row_count) for way in ways}
    others = [c for c in vertices.columns if c != "id"]
    for r in rounds(max_rounds, "the spread of messages"):
        senders = state.filter("active").select("id", "value")
        sent = None
        for way in ways:
            hot, n = hubs[way]
            part = send(edges, senders, n, way, hot).select(F.col("dst" if way == "out" else "src").alias("id"), message.alias("msg"))
            sent = part if sent is None else sent.unionByName(part)
        merged = sent.groupBy("id").agg(merge(F.col("msg")).alias("msg"))
        new = F.when(F.col("msg").isNull(), F.col("value")).otherwise(apply)
        step = state.drop("active").join(merged, "id", "left").withColumn("new", new)
        step = step.withColumn("active", F.col("msg").isNotNull() & active)
        step = tables.table(step.select("id", *others, F.col("new").alias("value"), "active"), "state", n=F.count(F.when(F.col("active"), 1)), **(aggregates or {}))
        tables.drop(state)
        state = step
        if not state.metrics["n"] or (halt and halt(r, state.metrics)):
            break
    return state.drop("active")


def take_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows without replacement, the same for the same seed and data whatever the partitions."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def top_k(df: DataFrame, k: int, value: str, key: str = "id") -> DataFrame:
    """The k rows of the largest value, the smallest key among equals."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)

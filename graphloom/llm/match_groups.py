"""Consolidating pairwise matches into groups: connected components by reduction.

Each round strips vertices with one neighbour and splices out vertices with two (an independent set of each chain,
chosen by hash: list ranking by random mates). What is left, the core, is contracted: every vertex points to its
neighbour of the highest degree unless its own is higher, and each tree of such pointers becomes one vertex, which at
least halves the vertices. Each removed vertex keeps a pointer to one that was removed later; labels are restored to
them in reverse order. Every round shrinks the graph by a set share, so all rounds together read a small multiple of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.balance import lookup
from graphloom.functions.names import plain_form
from graphloom.graph import dense_ranks, encode
from graphloom.scratch import Scratch

#: Stripping goes on while a round removes at least this share of the edges; then the core is contracted.
WORTH_STRIPPING = 0.25


def _both(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, in one pass."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    return edges.select(F.inline(ends))


def _edge(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def groups(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """v, group: every vertex of the links with the smallest vertex it is directly or indirectly linked to.

    Links are undirected; repeated links and links of a vertex to itself are allowed (the latter only make the vertex
    known), links with a null end are ignored. Works for any ordered key type. An empty table gives an empty result.
    """
    tables = Scratch(links.sparkSession, "groups")
    rooted = tables.table(roots(links, tables, left, right), "rooted")
    least = rooted.groupBy("root").agg(F.min("v").alias("group"))
    return lookup(rooted, least, "root", rooted.row_count, "v", "inner").select("v", "group")


def roots(links: DataFrame, tables: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """v, root: every vertex with one vertex of its group, the same for all of the group.

    All groupings are pre-aggregated to one row a vertex or edge; joins on vertices are salted where one is hot;
    edges are removed by their own key, so a hub's edges never meet in one task.
    """
    pairs = links.select(F.col(left).alias("x"), F.col(right).alias("y")).dropna().select(*_edge(F.col("x"), F.col("y"))).distinct()
    pairs = tables.table(pairs, "pairs", loops=F.count(F.when(F.col("a") == F.col("b"), 1)))
    edges, n = pairs.filter("a <> b"), pairs.row_count - pairs.metrics["loops"]
    removed: list[DataFrame] = []
    sizes: list[int] = []  # no more rows than twice the edges of the round
    gain = 1.0
    while n and gain >= WORTH_STRIPPING:
        gone, rest = _strip(edges, len(removed), tables)
        removed.append(gone)
        sizes.append(2 * n)
        gain, n, edges = 1 - rest.row_count / n, rest.row_count, rest
    while n:
        gone, edges = _contract(edges, len(removed), n, tables)
        removed.append(gone)
        sizes.append(2 * n)
        n = edges.row_count

    selves = pairs.filter("a = b").select(F.col("a").alias("v"), F.col("a").alias("root"))
    labels = None
    for i, gone in reversed(list(enumerate(removed))):
        if labels is None:
            found = gone.select("v", F.col("to").alias("root"))
        else:
            known = labels.select(F.col("v").alias("to"), "root")
            found = lookup(gone, known, "to", sizes[i], "v").select("v", F.coalesce("root", "to").alias("root"))
            found = tables.table(found, "labels")
        labels = found if labels is None else labels.unionByName(found)
    if labels is None:
        return selves
    # vertices that were never removed are the roots; those known only by links to themselves are missing still
    out = labels.unionByName(labels.select(F.col("root").alias("v"), "root").distinct())
    if not pairs.metrics["loops"]:
        return out
    return out.unionByName(selves.join(out.select("v"), "v", "left_anti"))


def _strip(edges: DataFrame, r: int, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """One round: vertices of degree one go, and of those of degree two an independent set not next to a leaf.

    Returns the removed vertices (v, to) and the edges of the rest. Whatever ``to`` names stays in this round.
    """
    v, w, a, b = (F.col(c) for c in "vwab")
    ends = _both(edges).groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    ends = tables.table(ends.filter("d <= 2"), "ends")
    # the edges of these vertices by the edge's own key, with the degree of each end, null if above two
    slots = ends.select("v", "d", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("w")).select("v", "d", *_edge(v, w))
    met = slots.groupBy("a", "b").agg(F.max(F.when(v == a, F.col("d"))).alias("da"), F.max(F.when(v == b, F.col("d"))).alias("db"))
    met = tables.table(met, "met")
    da, db = F.coalesce("da", F.lit(3)), F.coalesce("db", F.lit(3))
    # of two leaves linked to each other the larger goes
    leaves = met.filter((da == 1) | (db == 1)).select("a", "b", F.when(db == 1, b).otherwise(a).alias("v"), F.when(db == 1, a).otherwise(b).alias("to"))
    toss = F.xxhash64(a, F.lit(r)) < F.xxhash64(b, F.lit(r))
    blocked = F.when((da == 2) & (db == 2), F.when(toss, b).otherwise(a)).when((da == 1) & (db == 2), b).when((da == 2) & (db == 1), a)
    blocked = met.select(blocked.alias("v")).filter(v.isNotNull()).distinct()
    spliced = ends.filter("d = 2").join(blocked, "v", "left_anti").select("v", F.col("lo").alias("to"), "hi")
    gone = tables.table(leaves.select("v", "to", F.lit(None).cast(ends.schema["hi"].dataType).alias("hi")).unionByName(spliced), "gone")
    # every removed vertex loses the edge to ``to``, a spliced one also that to ``hi``, and its neighbours get linked
    spliced = gone.filter(F.col("hi").isNotNull())
    cut = gone.select(*_edge(v, F.col("to"))).unionByName(spliced.select(*_edge(v, F.col("hi"))))
    stay = edges.select("a", "b").unionByName(spliced.select(F.col("to").alias("a"), F.col("hi").alias("b")))
    rest = stay.withColumn("cut", F.lit(0)).unionByName(cut.withColumn("cut", F.lit(1))).groupBy("a", "b").agg(F.max("cut").alias("cut"))
    rest = tables.table(rest.filter("cut = 0").select("a", "b"), "edges")
    tables.drop(ends, met, edges)
    return gone.select("v", "to"), rest


def _contract(edges: DataFrame, r: int, n: int, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """One round on the core: trees of pointers to the neighbour of the highest degree become single vertices.

    Pointers rise, so they form no circles; pointer doubling over the vertices, in as many steps as the tallest tree has
    binary digits of height, takes each to its top.
    """
    degree = tables.table(_both(edges).groupBy("v").agg(F.count(F.lit(1)).alias("d")), "degree")
    order = F.struct(F.col("d").alias("d"), F.xxhash64("w", F.lit(r)).alias("h"), F.col("w").alias("w"))
    arcs = lookup(_both(edges), degree.select(F.col("v").alias("w"), "d"), "w", 2 * n, "v", "inner")
    best = arcs.groupBy("v").agg(F.max(order).alias("best"))
    own = F.struct(F.col("d").alias("d"), F.xxhash64("v", F.lit(r)).alias("h"), F.col("v").alias("w"))
    top = F.when(own > F.col("best"), F.col("v")).otherwise(F.col("best.w"))
    up = tables.table(best.join(degree, "v").select("v", top.alias("to")), "up", low=F.count(F.when(F.col("v") != F.col("to"), 1)))
    while True:
        higher = up.select(F.col("v").alias("to"), F.col("to").alias("over"))
        step = lookup(up, higher, "to", up.row_count, "v", "inner").select("v", F.col("over").alias("to"), (F.col("over") != F.col("to")).alias("moved"))
        step = tables.table(step, "up", moved=F.count(F.when(F.col("moved"), 1)))
        tables.drop(up)
        up = step.drop("moved")
        up.row_count = step.row_count
        if not step.metrics["moved"]:
            break
    gone = up.filter("v <> to")
    out = edges
    for end in "ab":
        moved = up.select(F.col("v").alias(end), "to")
        out = lookup(out, moved, end, n, "b" if end == "a" else "a", "inner").withColumn(end, F.col("to")).drop("to")
    out = tables.table(out.filter("a <> b").select(*_edge(F.col("a"), F.col("b"))).distinct(), "edges")
    tables.drop(degree, edges)
    return gone, out


def name_groups(df: DataFrame, left: str = "c0", right: str = "c1", dense: bool = False) -> DataFrame:
    """name, group_name: the groups of the plain forms of two name columns. Rows with a null name, or one without any
    letter or digit, are left out; the smallest name is by code points.

    The reduction runs on numbers: 64-bit hashes of the names, if no two names share one, else (or if ``dense`` is set)
    dense ranks. Names are read again only to name the groups.
    """
    tables = Scratch(df.sparkSession, "names")
    plain = df.select(plain_form(left).alias("x"), plain_form(right).alias("y")).filter("x <> '' and y <> ''")
    plain = tables.table(plain, "plain")
    names = plain.select(F.explode(F.array("x", "y")).alias("name")).distinct().withColumn("v", F.xxhash64("name"))
    names = tables.table(names, "names")
    if not dense and names.select("v").distinct().count() == names.row_count:
        links = plain.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b"))
    else:
        numbers = tables.table(dense_ranks(names.select("name"), ["name"], tables).withColumnRenamed("id", "v"), "numbers")
        edges = plain.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit(1).alias("weight"))
        links = encode(edges, numbers.withColumnRenamed("v", "id"), plain.row_count).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        names = numbers
    rooted = tables.table(names.join(roots(links, tables), "v").select("name", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("name").alias("group_name"))
    return lookup(rooted, least, "root", rooted.row_count, "name", "inner").select("name", "group_name")

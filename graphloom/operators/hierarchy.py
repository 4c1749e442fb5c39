"""Parent-child links to whole hierarchies: path, depth, root, subtree size, descendants and cycles of every node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.balance import lookup
from graphloom.scratch import Scratch

#: Chains are compressed in rounds whose peeling would remove less than this share of the nodes.
WORTH_PEELING = 0.5


def hierarchy(links: DataFrame, paths: bool = True) -> DataFrame:
    """links: ``node`` bigint (unique, not null), ``parent`` bigint (null, or no node of the table: a root).

    Result: node, parent, root, depth (root: 0), path array<bigint> (root to node), subtree (the node and its
    descendants), cycle (smallest node of the circle the node is on or below; then path, root, depth, subtree are null).
    A node that is its own parent is a root. Without ``paths`` there is no column path, and nothing as long as a path is
    ever built. An empty table gives an empty result.

    Bottom-up peeling: each round takes the nodes without children left and sends their subtree sizes to their parents,
    pre-aggregated. Where few such nodes are left, nodes with one child are taken as well, those of a chain chosen by
    hash so that no two neighbours go at once (a third of them on average); the child then hangs on the grandparent, and the edge remembers what lies
    between. So any tree, however tall, is gone in a logarithmic number of rounds, and what is left in the end are
    circles, each shrunk to one node that points to itself. In reverse order the nodes get path, depth and circle from
    the node they hung on. Descendants stay rows (:func:`descendants`): the list of a root's descendants could hold any
    share of all rows.
    """
    tables = Scratch(links.sparkSession, "hierarchy")
    alive = _marked(_state(links, tables), tables, paths)
    gone: list[tuple[DataFrame, DataFrame | None, int]] = []
    while alive.metrics["open"]:
        chains = alive.metrics["leaves"] < WORTH_PEELING * alive.metrics["open"] and alive.metrics["chained"]
        left, out = alive, None
        if chains:
            out = alive.filter("chained").drop("leaf", "chained", "ring")
            left = tables.table(_hung_over(alive.filter("not chained"), out, paths), "hung")
        gone.append((left.filter("leaf").drop("leaf", "chained"), out, alive.metrics["leaves"] + (alive.metrics["chained"] if chains else 0)))
        alive = _marked(left, tables, paths)
    return _restored(alive, gone, tables, paths)


def _state(links: DataFrame, tables: Scratch) -> DataFrame:
    """The nodes as they start: node, parent, up (the node it hangs on; null for a root), between (how many nodes were
    taken out on the way up), least (the smallest of them), via (all of them, from above), size (of the node and what
    was peeled below it), above (sizes of what was taken out on the way up), leaf, chained."""
    base = links.select(F.col("node").cast("bigint").alias("node"), F.col("parent").cast("bigint").alias("parent"))
    base = tables.table(base.withColumn("parent", F.when(F.col("parent") != F.col("node"), F.col("parent"))), "links")
    known = base.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    out = lookup(base, known, "parent", base.row_count, "node").withColumn("parent", F.when(F.col("there"), F.col("parent")))
    out = out.select(
        "node", "parent", F.col("parent").alias("up"), zero.alias("between"), none.alias("least"), F.array().cast("array<bigint>").alias("via"),
        F.lit(1).cast("bigint").alias("size"), zero.alias("above"), F.lit(False).alias("leaf"),
    )
    return tables.table(out, "start")


def _marked(state: DataFrame, tables: Scratch, paths: bool) -> DataFrame:
    """The nodes that are no leaves, with the sizes that the leaves sent, and newly marked: leaf (no child left), chained
    (one child, chosen to be taken out), child, inside (sizes of what was taken out on the way to that child). A node that points to itself is neither; it is what a circle shrinks to."""
    hangs = F.col("up").isNotNull() & (F.col("up") != F.col("node"))
    stays = ~F.col("leaf")
    told = state.filter(hangs).groupBy(F.col("up").alias("node")).agg(
        F.sum(F.when(F.col("leaf"), F.col("size") + F.col("above"))).alias("sent"), F.count(F.when(stays, 1)).alias("kids"), F.max(F.when(stays, F.col("node"))).alias("child"),
        F.max(F.when(stays, F.col("above"))).alias("inside"),
    )
    kids = F.coalesce("kids", F.lit(0))
    ring = F.coalesce(F.col("up") == F.col("node"), F.lit(False))
    lot = lambda c: F.xxhash64(c, F.lit(tables.made))
    # higher than both neighbours, so neither of them goes as well
    chained = F.coalesce(hangs & (kids == 1) & (lot("node") > lot("up")) & (lot("node") > lot("child")), F.lit(False))
    out = state.filter(stays).drop("child", "inside", "leaf").join(told, "node", "left").select(
        "node", "parent", "up", "between", "least", *["via"] * paths, (F.col("size") + F.coalesce("sent", F.lit(0))).alias("size"), "above",
        "child", "inside", (~ring & (kids == 0)).alias("leaf"), chained.alias("chained"), ring.alias("ring"),
    )
    count = lambda c: F.count(F.when(c, 1))
    return tables.table(out, "marked", open=count(~F.col("ring")), leaves=count(F.col("leaf")), chained=count(F.col("chained")))


def _hung_over(stay: DataFrame, out: DataFrame, paths: bool) -> DataFrame:
    """The nodes that stay; the one child of each node that is taken out hangs on the node above that."""
    over = out.select(
        F.col("child").alias("node"), F.col("up").alias("up2"), F.col("node").alias("mid"), F.col("between").alias("between2"), F.col("least").alias("least2"),
        (F.col("size") + F.col("above")).alias("above2"), *[F.col("via").alias("via2")] * paths,
    )
    hung = F.col("mid").isNotNull()
    via = F.when(hung, F.concat("via2", F.array("mid"), "via")).otherwise(F.col("via")).alias("via")
    return stay.join(over, "node", "left").select(
        "node", "parent", F.when(hung, F.col("up2")).otherwise(F.col("up")).alias("up"),
        F.when(hung, F.col("between") + F.col("between2") + 1).otherwise(F.col("between")).alias("between"), F.least("least", "least2", "mid").alias("least"),
        *[via] * paths, "size", F.when(hung, F.col("above") + F.col("above2")).otherwise(F.col("above")).alias("above"), "child", "inside", "leaf", "chained",
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _restored(rings: DataFrame, gone: list[tuple[DataFrame, DataFrame | None, int]], tables: Scratch, paths: bool) -> DataFrame:
    """All nodes with their results, those removed last first. A node taken out of a chain has its subtree from its child,
    which is either known or a leaf of the same round."""
    none = F.lit(None).cast("bigint")
    facts = ["node", "parent", "root", "depth", *["path"] * paths, "subtree", "cycle"]
    circle = rings.select("node", "parent", none.alias("root"), none.alias("depth"), *[F.lit(None).cast("array<bigint>").alias("path")] * paths,
                          none.alias("subtree"), F.least("node", "least").alias("cycle"))
    parts = [(circle, rings.row_count)]
    for leaves, out, n in reversed(gone):
        known = _union([p for p, _ in parts])
        here = leaves.select("node", "parent", "up", "between", *["via"] * paths, F.col("size").alias("subtree"))
        if out is not None:
            below = known.select(F.col("node").alias("child"), "subtree").unionByName(leaves.select(F.col("node").alias("child"), F.col("size").alias("subtree")))
            taken = out.join(below, "child", "left").select("node", "parent", "up", "between", *["via"] * paths, (F.col("size") + F.col("inside") + F.col("subtree")).alias("subtree"))
            here = here.unionByName(taken)
        told = known.select(F.col("node").alias("up"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), *[F.col("path").alias("path2")] * paths, "cycle")
        found = lookup(here, told, "up", n, "node")
        top, lost = F.col("up").isNull(), F.col("cycle").isNotNull()
        path = F.when(top, F.array("node")).otherwise(F.concat("path2", "via", F.array("node"))).alias("path")
        found = found.select(
            "node", "parent", F.when(top, F.col("node")).otherwise(F.col("root2")).alias("root"),
            F.when(top, F.lit(0)).otherwise(F.col("depth2") + F.col("between") + 1).cast("bigint").alias("depth"), *[path] * paths,
            F.when(~lost, F.col("subtree")).alias("subtree"), "cycle",
        )
        # what was found before is written again with it, unless it is much more: so there are few tables to read
        merged = []
        while parts and parts[-1][1] <= 2 * n:
            before, m = parts.pop()
            found, n = before.unionByName(found), n + m
            merged.append(before)
        parts.append((tables.table(found, "found"), n))
        tables.drop(*merged)
    out = _union([p for p, _ in parts])
    return out.select(*facts).withColumn("depth", F.col("depth").cast("int"))


def descendants(tree: DataFrame) -> DataFrame:
    """ancestor, descendant, distance (>= 1) of the nodes with a path, as rows; no list of a node's descendants is built."""
    steps = tree.filter(F.col("path").isNotNull()).select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.filter(F.col("at") < F.col("depth")).select("ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))


def community_parents(states: DataFrame) -> DataFrame:
    """The links (node, parent) that Louvain states give: of each vertex_id the row with the latest recorded_at counts
    (among equals the largest row_id; a null recorded_at is earliest).

    The parent is the vertex in ``community``; if that is null or -1, the vertex whose counting name equals
    communityName apart from case and outer blanks (the smallest vertex_id if several do). Null vertex_ids are left out.
    """
    from graphloom.functions.names import folded_name

    spark = states.sparkSession
    tables = Scratch(spark, "parents")
    row = F.struct("recorded_at", "row_id", "name", "community", "communityName")
    last = states.filter(F.col("vertex_id").isNotNull()).groupBy("vertex_id").agg(F.max(row).alias("r"))
    last = tables.table(last.select(F.col("vertex_id").alias("node"), folded_name("r.name").alias("own"), "r.community", folded_name("r.communityName").alias("of")), "last")
    direct = F.col("community").isNotNull() & (F.col("community") != -1)
    by_name = last.filter(~direct | F.col("community").isNull()).select("node", "of")
    names = last.filter(F.col("own").isNotNull()).groupBy(F.col("own").alias("of")).agg(F.min("node").alias("parent"))
    named = lookup(by_name, names, "of", last.row_count, "node").select("node", "parent")
    return last.filter(direct).select("node", F.col("community").alias("parent")).unionByName(named)

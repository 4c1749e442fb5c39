"""Louvain communities with exact integer scores: single level, contraction, levels, and the table of levels.

Two sets of rules: ``NUMERIC`` (messages both ways, ties to the largest id, the first cycle moves to smaller ids only) and
``TEXT`` (edges given in both directions, messages along them, ties to the smallest id, the first cycle moves to larger
ids only, community totals unknown in the first cycle).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.balance import hot_keys, known_hot, lookup
from graphloom.graph import merge_parallel, reverse_duplicated
from graphloom.scratch import Scratch

NUMERIC, TEXT = "numeric", "text"
MIN_PROGRESS, PROGRESS_COUNTER = 2000, 1
#: A level counts if it raises the modularity by more than this.
MIN_GAIN = 0.001
MAX_CYCLES = 100_000
_BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Hubs:
    """Vertices with so many edges that joins on them are salted: as senders and as receivers of messages, which are no
    more than the edges; rows is the number of edges in both directions if there are any, and vertices that of vertices."""

    senders: DataFrame | None = None
    receivers: DataFrame | None = None
    rows: int = 0
    vertices: int = 0

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame, tables: Scratch, rules: str) -> Hubs:
        arcs, n = (edges, edges.row_count) if rules == TEXT else (reverse_duplicated(edges), 2 * edges.row_count)
        senders, rows = known_hot(tables, arcs, "src", n)
        if rules != TEXT:  # every edge goes both ways
            return cls(senders, None if senders is None else senders.withColumnRenamed("src", "id"), rows, vertices.row_count)
        receivers, more = known_hot(tables, arcs.withColumnRenamed("dst", "id"), "id", n)
        if not rows and not more:
            return cls(vertices=vertices.row_count)
        none = hot_keys(arcs.limit(0), ["src"], 1)
        receivers = none.withColumnRenamed("src", "id") if receivers is None else receivers
        return cls(none if senders is None else senders, receivers, n, vertices.row_count)


NONE = Hubs()


@dataclass
class Level:
    """One level: vertices (id, name, community, communityName, communitySigmaTot, internalWeight, nodeWeight, changed),
    its edges, the modularity, the number of passes (pairs of cycles), and its hubs."""

    vertices: DataFrame
    edges: DataFrame
    q: float
    passes: int
    hubs: Hubs = NONE


@dataclass
class Louvain:
    levels: list[Level] = field(default_factory=list)
    #: Modularities of all levels run, the one that gained too little included.
    tried: list[float] = field(default_factory=list)

    def q_values(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, lv.q) for i, lv in enumerate(self.levels)], "level int, q double")

    def labels(self) -> DataFrame:
        """id, community: each first vertex with its community on the last level saved."""
        table = dendrogram([lv.vertices for lv in self.levels])
        return table.select("id", F.coalesce(*[F.col(f"c{i}") for i in reversed(range(len(self.levels)))]).alias("community"))


def initial(edges: DataFrame, names: DataFrame | None = None, rules: str = NUMERIC) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): every node its own community. The node weight is that of all edges at the node, a loop
    counting twice (under TEXT: of the edges that leave it); parallel edges are merged. names (id, name) is optional."""
    merged = merge_parallel(edges)
    both = merged if rules == TEXT else reverse_duplicated(merged)
    weights = both.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("weight").alias("w")), F.struct(F.col("dst").alias("id"), F.lit(0).cast("bigint").alias("w")))))
    nodes = weights.groupBy("id").agg(F.sum("w").cast("bigint").alias("nodeWeight"))
    named = nodes.join(names, "id", "left") if names is not None else nodes.withColumn("name", F.col("id").cast("string"))
    sigma = F.lit(0).cast("bigint") if rules == TEXT else F.col("nodeWeight")
    vertices = named.select(
        "id", "name", F.col("id").alias("community"), F.col("name").alias("communityName"), sigma.alias("communitySigmaTot"),
        F.lit(0).cast("bigint").alias("internalWeight"), "nodeWeight", F.lit(False).alias("changed"),
    )
    return vertices, merged


def community_messages(vertices: DataFrame, edges: DataFrame, rules: str = NUMERIC, hubs: Hubs = NONE) -> DataFrame:
    """id, c, cName, cSigma, w: the weight of each vertex's edges to each neighbouring community."""
    arcs = edges if rules == TEXT else reverse_duplicated(edges)
    told = vertices.select(F.col("id").alias("src"), F.col("community").alias("c"), F.col("communityName").alias("cName"), F.col("communitySigmaTot").alias("cSigma"))
    met = lookup(arcs, told, "src", hubs.rows, "dst", "inner", hot=hubs.senders)
    return met.groupBy(F.col("dst").alias("id"), "c", "cName", "cSigma").agg(F.sum("weight").cast("bigint").alias("w"))


def _score(total: Column) -> Column:
    """k_in * M - k_i * sigma: the order of the gains in modularity, in whole numbers."""
    k = F.col("nodeWeight") + F.col("internalWeight")
    own = F.col("c") == F.col("community")
    k_in = F.col("w") + F.when(own, F.col("internalWeight")).otherwise(F.lit(0))
    sigma = F.col("cSigma") - F.when(own, k).otherwise(F.lit(0))
    exact = k_in.cast("decimal(19,0)") * total.cast("decimal(19,0)") - k.cast("decimal(19,0)") * sigma.cast("decimal(19,0)")
    return F.when(own & (sigma == 0), F.lit(0).cast(_BIG)).otherwise(exact.cast(_BIG))


def best_moves(vertices: DataFrame, messages: DataFrame, total: int, rules: str = NUMERIC, hubs: Hubs = NONE) -> DataFrame:
    """id, best, bestName, bestSigma: the community of the largest positive gain; vertices without one are absent."""
    met = lookup(messages, vertices, "id", hubs.rows, "c", "inner", hot=hubs.receivers)
    scored = met.select("id", "c", "cName", "cSigma", _score(F.lit(total)).alias("score")).filter("score > 0")
    if rules == NUMERIC:
        best = F.max(F.struct("score", "c", "cName", "cSigma")).alias("b")
        return scored.groupBy("id").agg(best).select("id", F.col("b.c").alias("best"), F.col("b.cName").alias("bestName"), F.col("b.cSigma").alias("bestSigma"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "c", "cName", "cSigma")).alias("b")
    return scored.groupBy("id").agg(best).select("id", F.col("b.c").alias("best"), F.col("b.cName").alias("bestName"), F.col("b.cSigma").alias("bestSigma"))


def cycle(vertices: DataFrame, edges: DataFrame, total: int, first_half: bool, rules: str = NUMERIC, hubs: Hubs = NONE) -> DataFrame:
    """The vertices after one cycle: moves of one direction only, then new community totals."""
    messages = community_messages(vertices, edges, rules, hubs)
    moves = best_moves(vertices, messages, total, rules, hubs)
    if rules == TEXT:  # vertices without edges of their own leave at the first step
        moves = moves.join(edges.select(F.col("src").alias("id")), "id", "left_semi")
    down = first_half if rules == NUMERIC else not first_half
    allowed = F.col("community") > F.col("best") if down else F.col("community") < F.col("best")
    moved = F.coalesce(allowed, F.lit(False))
    after = vertices.join(moves, "id", "left").select(
        "id", "name", F.when(moved, F.col("best")).otherwise(F.col("community")).alias("community"),
        F.when(moved, F.col("bestName")).otherwise(F.col("communityName")).alias("communityName"),
        "internalWeight", "nodeWeight", moved.alias("changed"),
    )
    totals = after.groupBy("community").agg(F.sum(F.col("nodeWeight") + F.col("internalWeight")).cast("bigint").alias("communitySigmaTot"))
    out = lookup(after, totals, "community", hubs.vertices, "id", "inner")
    return out.select(*vertices.columns)


def modularity(vertices: DataFrame, edges: DataFrame, total: int, rules: str = NUMERIC, count_isolated: bool = False, hubs: Hubs = NONE) -> DataFrame:
    """One row, q: the sum over vertices of k_in / M - sigma k / M^2, each taken as 0 where negative.

    Vertices without edges don't count, as their neighbourhood is empty, unless count_isolated is set."""
    inside = community_messages(vertices, edges, rules, hubs).select("id", "c", "w")
    own = lookup(inside, vertices.select("id", "community"), "id", hubs.rows, "c", "inner", hot=hubs.receivers).groupBy("id").agg(F.sum(F.when(F.col("c") == F.col("community"), F.col("w")).otherwise(F.lit(0))).alias("w"))
    met = vertices.join(own, "id", "left" if count_isolated or rules == TEXT else "inner")
    k, m = F.col("nodeWeight") + F.col("internalWeight"), F.lit(float(total))
    q = (F.col("internalWeight") + F.coalesce("w", F.lit(0))) / m - F.col("communitySigmaTot").cast("double") * k.cast("double") / (m * m)
    return met.agg(F.coalesce(F.sum(F.greatest(F.lit(0.0), q)), F.lit(0.0)).alias("q"))


def total_weight(vertices: DataFrame) -> int:
    return vertices.agg(F.coalesce(F.sum(F.col("internalWeight") + F.col("nodeWeight")), F.lit(0)).alias("m")).first().m


def one_level(
    vertices: DataFrame, edges: DataFrame, tables: Scratch, rules: str = NUMERIC, min_progress: int = MIN_PROGRESS,
    progress_counter: int = PROGRESS_COUNTER, count_isolated: bool = False,
) -> Level:
    """Cycles in pairs until too few vertices move."""
    vertices, edges = tables.table(vertices, "vertices"), tables.table(edges, "edges")
    total, hubs = total_weight(vertices), Hubs.of(vertices, edges, tables, rules)
    count = stop = moved = last = 0
    history: list[int] = []
    while edges.row_count:
        count += 1
        first_half = count % 2 == 1
        after = tables.table(cycle(vertices, edges, total, first_half, rules, hubs), "vertices", n=F.count(F.when(F.col("changed"), 1)))
        if rules == TEXT:  # whether a vertex moved in the pass, not how often, is counted
            flag = after.select("id", "changed") if first_half else flag.join(after.select("id", F.col("changed").alias("again")), "id").select("id", (F.col("changed") | F.col("again")).alias("changed"))
            moved = after.metrics["n"] if first_half else flag.filter("changed").count()
        else:
            moved = after.metrics["n"] + (0 if first_half else moved)
        if first_half:
            tables.drop(vertices)
        vertices = after
        if first_half:
            continue
        if rules == TEXT:
            history.append(moved)
            held = sum(now >= before - min_progress for before, now in zip([history[0], *history], history))
            if not moved or held > progress_counter or count >= MAX_CYCLES:
                break
            continue
        stop += moved >= last - min_progress
        last = moved
        if stop > progress_counter or not moved or count >= MAX_CYCLES:
            break
    q = modularity(vertices, edges, total, rules, count_isolated, hubs).first().q if total else 0.0
    return Level(vertices, edges, q, count // 2, hubs)


def compress(vertices: DataFrame, edges: DataFrame, rules: str = NUMERIC, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) with one vertex a community: internal weight is that of its vertices and twice that of the
    edges inside (under TEXT both directions are there and count once); edges between communities add up."""
    label = vertices.select("id", "community")
    rows = edges.count() if rows is None else rows
    met = lookup(edges, label.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src", rows, "dst", "inner")
    met = lookup(met, label.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst", rows, "src", "inner")
    times = 1 if rules == TEXT else 2
    inside = met.filter("cs = cd").select(F.col("cs").alias("id"), (F.col("weight") * times).alias("w"))
    own = vertices.select(F.col("community").alias("id"), F.col("internalWeight").alias("w"), "communityName")
    weights = own.unionByName(inside, allowMissingColumns=True).groupBy("id").agg(F.sum("w").cast("bigint").alias("internalWeight"), F.max("communityName").alias("name"))
    pair = (F.col("cs"), F.col("cd")) if rules == TEXT else (F.least("cs", "cd"), F.greatest("cs", "cd"))
    between = met.filter("cs <> cd").groupBy(pair[0].alias("src"), pair[1].alias("dst")).agg(F.sum("weight").cast("bigint").alias("weight"))
    ends = between if rules == TEXT else reverse_duplicated(between)
    nodes = ends.groupBy(F.col("src").alias("id")).agg(F.sum("weight").cast("bigint").alias("nw"))
    out = weights.join(nodes, "id", "left").withColumn("nodeWeight", F.coalesce("nw", F.lit(0)).cast("bigint"))
    return out.select(
        "id", "name", F.col("id").alias("community"), F.col("name").alias("communityName"), (F.col("nodeWeight") + F.col("internalWeight")).alias("communitySigmaTot"),
        "internalWeight", "nodeWeight", F.lit(False).alias("changed"),
    ), between


def louvain(
    edges: DataFrame, names: DataFrame | None = None, rules: str = NUMERIC, min_progress: int = MIN_PROGRESS, progress_counter: int = PROGRESS_COUNTER,
    count_isolated: bool = False, save=None,
) -> Louvain:
    """Levels of communities of edges (src, dst, weight); ``save(index, level)`` is called for each level kept.

    NUMERIC: a level is kept, and the next tried, while the modularity gains more than MIN_GAIN; level 0 is always kept.
    TEXT: every level is kept; the last is one of at most two passes, or whose modularity is not larger in its first
    four digits. min_progress and progress_counter are those of the command lines (runs of fewer moved vertices than
    min_progress a pass end after two passes).
    """
    tables = Scratch(edges.sparkSession, "louvain")
    edges = edges.dropna(subset=["src", "dst"]).withColumn("weight", F.coalesce("weight", F.lit(1)).cast("bigint"))
    vertices, edges = initial(edges, names, rules)
    out, before = Louvain(), -1.0
    while True:  # levels gain at least MIN_GAIN (TEXT: a ten-thousandth) of a modularity that is 1 at most
        level = one_level(vertices, edges, tables, rules, min_progress, progress_counter, count_isolated)
        out.tried.append(level.q)
        if rules == NUMERIC and not level.q > before + MIN_GAIN:
            break
        out.levels.append(level)
        if save:
            save(len(out.levels) - 1, level)
        stage = len(out.levels) - 1
        # the first two stages compare with zero
        if rules == TEXT and (level.passes <= 2 or int(level.q * 10_000) <= int((0.0 if stage < 2 else before) * 10_000)):
            break
        before = level.q
        vertices, edges = compress(level.vertices, level.edges, rules, level.edges.row_count)
    return out


def dendrogram(levels: list[DataFrame]) -> DataFrame:
    """id, c0, c1, ...: the community of each first vertex on every level; null where a community has no next one."""
    table, rows = levels[0].select("id", F.col("community").alias("c0")), getattr(levels[0], "row_count", None)
    rows = levels[0].count() if rows is None and len(levels) > 1 else rows
    for i, level in enumerate(levels[1:], 1):
        nxt = level.select(F.col("id").alias(f"c{i - 1}"), F.col("community").alias(f"c{i}"))
        table = lookup(table, nxt, f"c{i - 1}", rows, "id")
    return table.select("id", *[f"c{i}" for i in range(len(levels))])


def compress_community_rows(rows: DataFrame) -> DataFrame:
    """community, weight, target, w from rows of (id, community, internalWeight, edges map<target, weight>): weights inside
    add to the weight, others add up by target. One row a community and target, so that no task holds all of a
    community's; a community without outside edges has one row without a target."""
    spread = rows.select("community", F.inline(F.map_entries("edges")).alias("t", "w"))
    parts = rows.select("community", F.col("internalWeight").alias("w")).unionByName(spread.filter("t = community").select("community", "w"))
    own = parts.groupBy("community").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("weight"))
    outer = spread.filter("t is not null and t <> community").groupBy("community", F.col("t").alias("target")).agg(F.sum("w").cast("bigint").alias("w"))
    some = outer.select("community").distinct().withColumn("some", F.lit(True))
    alone = own.join(some, "community", "left_anti").select("community", F.lit(None).cast(outer.schema["target"].dataType).alias("target"), F.lit(None).cast("bigint").alias("w"))
    # one row a community carries its weight, and joins its targets by salt where there are many
    n = outer.count()
    met = lookup(outer, own, "community", n, "target", "inner") if n else outer.join(own, "community")
    return met.select("community", "weight", "target", "w").unionByName(alone.join(own, "community").select("community", "weight", "target", "w"))


def community_maps(compressed: DataFrame) -> DataFrame:
    """community, weight, edges (map) of such rows, for layouts that hold a community's edges in one value."""
    entry = F.struct("target", "w")
    out = compressed.groupBy("community", "weight").agg(F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), entry))).alias("e"))
    return out.select("community", "weight", F.map_from_entries("e").alias("edges"))

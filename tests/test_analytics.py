"""The analytics on hand-derived fixtures and against plain Python on random graphs."""

import random
from collections import Counter, defaultdict

import pytest
from fixtures import C2, C3, C4, F1, F2, F3, L2, L4, L6, P3, P4, W1, W3, W4, graph
from pyspark.sql import functions as F

from graphloom.operators import betweenness, bsp, components, leaf, louvain, neighbors, pagerank


def labels(df, value="component"):
    return {r.id: r[value] for r in df.collect()}


def test_components_of_the_largest_and_smallest_id(spark):
    assert Counter(labels(components.components(graph(spark, W4))).values()) == {880: 8, 900: 6, 14: 5, 435: 7}
    assert set(labels(components.components(graph(spark, W1), "min")).items()) == {(i, 1) for i in range(1, 7)}
    assert Counter(labels(components.components(graph(spark, W3 + " 99,99"))).values()) == {6: 6, 9: 3, 14: 5, 99: 1}
    assert components.components(graph(spark, W1).limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400), 1) for _ in range(300)] + [(i, i + 1, 1) for i in range(1000, 1100)] + [(2000, i, 1) for i in range(2001, 2200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 1, 1)], "src bigint, dst bigint, weight bigint")
    assert labels(components.components(df, "min")) == {v: find(v) for v in list(parent)}


def test_components_of_text(spark):
    both = "1,2 2,1 3,4 4,3 5,6 6,5 9,10 10,9"
    want = {"1": "2", "2": "2", "3": "4", "4": "4", "5": "6", "6": "6", "9": "9", "10": "9"}
    assert labels(components.components_text(graph(spark, both, str))) == want
    assert labels(components.components_text(graph(spark, "1,2 3,4 5,6 9,10", str), bidirectional=True)) == want
    assert labels(components.components_text(graph(spark, "3,1 1,2", str))) == {"3": "3", "1": "3", "2": "3"}


@pytest.mark.parametrize("text,survivors", [(W1, set()), (C2, {1, 2, 3}), (C3, {1, 2, 3, 4, 5}), (C4, {6, 7, 8, 9, 10, 11, 12, 25, 880})])
def test_leaf_compression(spark, text, survivors):
    left = leaf.leaf_compression(graph(spark, text)).collect()
    assert {v for r in left for v in (r.src, r.dst)} == survivors
    if text == C2:
        assert sorted((r.src, r.dst) for r in left) == [(1, 2), (1, 3), (2, 1), (2, 3), (2, 3), (3, 1), (3, 2)]


def test_leaf_folding(spark):
    edges, nodes = leaf.leaf_folding(graph(spark, F1, str))
    assert labels(nodes, "value") == {"1": 4, "2": 0, "3": 4, "4": 0, "5": 0}
    assert len(edges.collect()) == 20
    edges, nodes = leaf.leaf_folding(graph(spark, F2, str))
    assert labels(nodes, "value") == {"2": 1, "3": 1, "16": 1} and edges.count() == 0
    edges, nodes = leaf.leaf_folding(graph(spark, F3, str))
    assert labels(nodes, "value") == {"fir": 0, "elm": 0, "oak": 0, "yew": 1}
    assert ("oak", "ash") in {(r.src, r.dst) for r in edges.collect()}


def test_pagerank_delta(spark):
    r = labels(pagerank.pagerank_delta(graph(spark, C2)), "rank")
    assert [round(r[i], 6) for i in (1, 2, 3, 4, 5)] == [0.667618, 0.667618, 0.667618, 0.568412, 0.469206]
    r = labels(pagerank.pagerank_delta(graph(spark, "2,1 3,1 4,1 5,1 6,1")), "rank")
    assert round(r[1], 6) == 0.910417 and round(r[2], 6) == 0.308333
    r = labels(pagerank.pagerank_delta(graph(spark, P4)), "rank")
    assert round(r[9], 6) == 1.129251 and round(r[1], 6) == 0.229762


def test_pagerank_delta_stops_at_once_on_850_nodes(spark):
    def ring(n):
        return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1).alias("weight"))

    rank = pagerank.pagerank_delta(ring(850)).first().rank
    assert rank == pytest.approx(1.85 / 850)
    assert pagerank.pagerank_delta(ring(849)).first().rank == pytest.approx(2.5725 / 849, rel=1e-4)


def test_pagerank_power_and_library(spark):
    r = labels(pagerank.pagerank_power(graph(spark, " ".join(f"1,{i}" for i in range(2, 9)))), "rank")
    assert round(r[1], 6) == 0.01875 and round(r[8], 10) == 0.0210267857
    r = labels(pagerank.pagerank_power(graph(spark, " ".join(f"{i},1" for i in range(2, 9)))), "rank")
    assert round(r[1], 7) == 0.1303125
    r = labels(pagerank.pagerank_library(graph(spark, P3), 0.01), "rank")
    assert all(abs(v - 1) < 0.1 for v in r.values())


def test_louvain_levels(spark):
    found = louvain.louvain(graph(spark, L4))
    assert found.levels[0].q == pytest.approx(0.4134948096885813, abs=1e-12)
    v = {r.id: r for r in found.levels[0].vertices.collect()}
    assert {i: v[i].community for i in v} == {**dict.fromkeys(range(1, 6), 4), **dict.fromkeys(range(6, 10), 8)}
    assert (v[1].communitySigmaTot, v[9].communitySigmaTot) == (21, 13)
    assert [r.c0 for r in louvain.dendrogram([lv.vertices for lv in found.levels]).orderBy("id").collect()] == [4] * 5 + [8] * 4


def test_louvain_level_0_and_halt(spark):
    found = louvain.louvain(graph(spark, L2))
    assert found.tried == pytest.approx([0.4504132231404958, 0.2479338842975206])
    assert Counter(r.community for r in found.levels[0].vertices.collect()) == {1: 2, 4: 2, 5: 2, 10: 7}
    found = louvain.louvain(graph(spark, C4))
    assert found.tried == pytest.approx([0.6565743944636678, 0.7530276816608997, 0.24005190311418687])
    want = {13: 2, 15: 2, 4: 2, 25: 3, 11: 3, 0: 2, 655: 2, 1: 3, 33: 2, 7: 3, 44: 2}
    assert Counter(r.community for r in found.levels[0].vertices.collect()) == want


def brute_level0(edges):
    """Communities and passes of the first level by the numeric rules, on dictionaries."""
    near, k = defaultdict(Counter), Counter()
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near[x][y] += w
            k[x] += w
    total, com, sigma, passes, stop, last = sum(k.values()), {v: v for v in k}, Counter(k), 0, 0, 0
    while True:
        moved = 0
        for down in (True, False):
            new = {}
            for v in k:
                to = Counter()
                for u, w in near[v].items():
                    to[com[u]] += w
                scores = []
                for c, w in to.items():
                    rest = sigma[c] - (k[v] if c == com[v] else 0)
                    scores.append((0 if c == com[v] and not rest else w * total - k[v] * rest, c))
                score, c = max(scores)
                if score > 0 and (c < com[v] if down else c > com[v]):
                    new[v] = c
            com.update(new)
            moved += len(new)
            sigma = Counter()
            for v, c in com.items():
                sigma[c] += k[v]
        passes += 1
        stop += moved >= last - 2000
        last = moved
        if stop > 1 or not moved:
            return com, passes


def test_louvain_level_0_queries_go_on_while_moves_fall(spark, tmp_path):
    from graphloom.plans import graph_queries

    rng = random.Random(15)
    edges = [(rng.randrange(9000), int(9000 * rng.random() ** 2), rng.choice([1, 1, 2])) for _ in range(18000)]
    spark.createDataFrame(edges, "src bigint, dst bigint, weight bigint").write.parquet(str(tmp_path / "edges_numeric.parquet"))
    want, passes = brute_level0(edges)
    assert passes > 2
    rows = graph_queries.louvain_level0(spark, str(tmp_path)).collect()
    assert {r.id: r.community for r in rows} == want
    assert {r.id for r in graph_queries.louvain_compress(spark, str(tmp_path)).collect()} == set(want.values())
    cut = {(min(want[a], want[b]), max(want[a], want[b])) for a, b, _ in edges if want[a] != want[b]}
    assert {(r.src, r.dst) for r in graph_queries.louvain_compress_edges(spark, str(tmp_path)).collect()} == cut
    total, inside, sigma, k = 2 * sum(w for *_, w in edges), Counter(), Counter(), Counter()
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            k[x] += w
            sigma[want[x]] += w
            inside[x] += w * (want[x] == want[y])
    q = sum(max(0.0, inside[v] / total - sigma[want[v]] * k[v] / total**2) for v in k)
    assert graph_queries.louvain_modularity(spark, str(tmp_path)).first().q == pytest.approx(q, abs=1e-8)


def test_louvain_of_text(spark):
    found = louvain.louvain(graph(spark, L6, str), rules=louvain.TEXT)
    assert {r.community for r in found.levels[-1].vertices.collect()} == {"2"}
    found = louvain.louvain(graph(spark, "1,2", str), rules=louvain.TEXT)
    assert {(r.id, r.community) for r in found.levels[0].vertices.collect()} == {("1", "1"), ("2", "2")}


def test_community_rows_and_dendrogram(spark):
    rows = spark.createDataFrame([("1", "1", 0, {"2": 1})], "id string, community string, internalWeight bigint, edges map<string,bigint>")
    assert [tuple(x) for x in louvain.compress_community_rows(rows).collect()] == [("1", 0, "2", 1)]
    rows = spark.createDataFrame([("1", "a", 3, {"a": 2, "b": 1}), ("2", "a", 0, {"b": 4, "c": 1}), ("3", "z", 7, {})], rows.schema)
    got = louvain.compress_community_rows(rows)
    assert {tuple(x) for x in got.collect()} == {("a", 5, "b", 5), ("a", 5, "c", 1), ("z", 7, None, None)}
    assert {x.community: (x.weight, x.edges) for x in louvain.community_maps(got).collect()} == {"a": (5, {"b": 5, "c": 1}), "z": (7, {})}
    assert louvain.compress_community_rows(rows.limit(0)).count() == 0
    low = spark.createDataFrame([("1", "2"), ("2", "2"), ("3", "2"), ("5", "2"), ("7", "9")], "id string, community string")
    high = spark.createDataFrame([("2", "6")], "id string, community string")
    got = {tuple(r) for r in louvain.dendrogram([low, high]).collect()}
    assert got == {("1", "2", "6"), ("2", "2", "6"), ("3", "2", "6"), ("5", "2", "6"), ("7", "9", None)}


def test_neighboring_communities(spark):
    rows = neighbors.neighboring_communities(graph(spark, L4)).collect()
    assert len(rows) == 17
    assert {(r.src, r.dst) for r in rows if r.crosses} == {(1, 6)}
    assert {r.component for r in rows} == {9}


def test_betweenness_fixtures(spark):
    exact = labels(betweenness.betweenness(graph(spark, C2)), "betweenness")
    assert {k: round(v, 6) for k, v in exact.items()} == {1: 2.5, 2: 0.5, 3: 0, 4: 0, 5: 0}
    one = labels(betweenness.betweenness(graph(spark, C2), ties="one"), "betweenness")
    assert {k: round(v, 6) for k, v in one.items()} == {1: 2.0, 2: 1.0, 3: 0, 4: 0, 5: 0}
    r = labels(betweenness.betweenness(graph(spark, P4)), "betweenness")
    assert {k: round(v, 6) for k, v in r.items() if v} == {1: 4, 2: 3, 5: 3, 6: 3, 9: 1}


def brute_betweenness(edges):
    import heapq

    out = defaultdict(float)
    after, nodes = defaultdict(dict), set()
    for a, b, w in edges:
        nodes |= {a, b}
        if a != b:
            after[a][b] = min(after[a].get(b, 10**9), w or 1)
    for s in nodes:
        dist, sigma, preds, order, heap = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], [(0, s)]
        done = set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u, w in after[v].items():
                if d + w < dist.get(u, 10**9):
                    dist[u], sigma[u], preds[u] = d + w, sigma[v], [v]
                    heapq.heappush(heap, (d + w, u))
                elif d + w == dist[u]:
                    sigma[u] += sigma[v]
                    preds[u].append(v)
        delta = defaultdict(float)
        for v in reversed(order):
            for p in preds[v]:
                delta[p] += sigma[p] / sigma[v] * (1 + delta[v])
            if v != s:
                out[v] += delta[v]
    return {v: out[v] for v in nodes}


def test_betweenness_against_brute_force_and_top_k(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(25), rng.randrange(25), rng.choice([0, 1, 1, 2, 3])) for _ in range(70)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight bigint")
    want = brute_betweenness(edges)
    got = labels(betweenness.betweenness(df), "betweenness")
    assert got == pytest.approx(want)
    found = betweenness.high_betweenness(df, k=4, batch=4, most_pivots=6)
    assert found.pivots == 8 and found.cycles == 2 and found.top.count() == 4


def _betweenness_in_few_jobs(spark, edges, kind="bigint", **how):
    """id to betweenness; a search of many rounds must not be as many jobs."""
    import uuid

    df = spark.createDataFrame(edges, f"src {kind}, dst {kind}, weight bigint")
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "betweenness")
    try:
        got = labels(betweenness.betweenness(df, **how), "betweenness")
        assert len(context.statusTracker().getJobIdsForGroup(group)) < 40
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return got


def _ladder(lengths):
    """Thirty steps with two ways round at each, an end that nothing leaves and a loop."""
    rng = random.Random(3)
    out = []
    for i in range(30):
        a, b, c, d = 3 * i, 3 * i + 1, 3 * i + 2, 3 * i + 3
        out += [(x, y, rng.choice(lengths)) for x, y in ((a, b), (a, c), (b, d), (c, d), (d, a))]
    return [*out, (7, 200, 1), (201, 201, 1)]


def test_exact_betweenness_of_a_long_graph_takes_few_jobs(spark):
    edges = _ladder([1])
    assert _betweenness_in_few_jobs(spark, edges) == pytest.approx(brute_betweenness(edges))


def test_betweenness_with_lengths_takes_few_jobs(spark):
    edges = [*_ladder([1, 2, 0, None]), (0, 90, 150), (90, 0, 2**40)]
    assert _betweenness_in_few_jobs(spark, edges) == pytest.approx(brute_betweenness([(a, b, w if w != 2**40 else 10**8) for a, b, w in edges]))


def test_betweenness_with_one_predecessor_takes_few_jobs(spark):
    """Of the two ways round, the one through the name that is larger as text carries all that lies behind."""
    steps = [("9", "10"), ("x", "é"), ("b", "B")] * 5
    edges, last = [], "0"
    for i, (one, other) in enumerate(steps):
        for mid in (one, other):
            edges += [(last, f"{mid}/{i}", 1), (f"{mid}/{i}", f"step{i:02d}", 1)]
        last = f"step{i:02d}"
    want, behind = {"0": 0.0}, 3 * len(steps)
    for i, (one, other) in enumerate(steps):
        behind -= 3
        before = 1 + 3 * i
        big, small = sorted((f"{one}/{i}", f"{other}/{i}"), reverse=True)
        want |= {big: before * (1 + behind), small: 0.0, f"step{i:02d}": (before + 2) * behind}
    assert _betweenness_in_few_jobs(spark, edges, "string", ties="one") == want


@pytest.mark.parametrize("why", ["edges", "lengths"])
def test_exact_betweenness_in_batches_where_a_task_cannot_hold_it(spark, monkeypatch, why):
    from graphloom.operators import all_pivots

    if why == "edges":
        monkeypatch.setattr(all_pivots, "MOST_PAIRS", 5)
    edges = [(1, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 1), (4, 5, 2 if why == "edges" else 2**61), (4, 6, 2)]
    got = labels(betweenness.betweenness(spark.createDataFrame(edges, "src bigint, dst bigint, weight bigint")), "betweenness")
    assert got == {1: 0, 2: 1.5, 3: 1.5, 4: 6, 5: 0, 6: 0}


def _many_edges(n, m, lengths, seed=4):
    import numpy as np

    rng = np.random.default_rng(seed)
    pairs = np.unique(rng.integers(0, n * n, m))
    hub = np.arange(1, n)
    pairs = np.unique(np.concatenate([pairs[pairs // n != pairs % n], hub, hub * n]))  # vertex 0 has edges from and to all
    return pairs // n, pairs % n, rng.choice(lengths, len(pairs))


@pytest.mark.parametrize("lengths", [[1], [1, 2], [3, 8], [5]])
def test_searches_by_rows_and_by_pairs_give_the_same(lengths, monkeypatch):
    import numpy as np

    from graphloom.operators import all_pivots

    n = 700
    src, dst, w = _many_edges(n, 4000, lengths)
    got = [all_pivots.summed_dependencies(n, src, dst, w, np.arange(5, n, 3))]
    monkeypatch.setattr(all_pivots, "LONGEST", 0)
    got.append(all_pivots.summed_dependencies(n, src, dst, w, np.arange(5, n, 3)))
    assert got[0] == pytest.approx(got[1]) and got[0].sum() > 0


def test_a_search_takes_little_time_a_pivot_and_edge():
    import time

    import numpy as np

    from graphloom.operators import all_pivots

    def taken(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    n, pivots = 2000, np.arange(0, 2000, 16)
    src, dst, w = _many_edges(n, 100_000, [1] * 20 + [2])
    slowness = min(taken(lambda: sum(range(50_000))) for _ in range(50)) * 1000  # 1 on a usual machine
    assert min(taken(lambda: all_pivots.summed_dependencies(n, src, dst, w, pivots)) for _ in range(3)) < 15e-9 * len(src) * len(pivots) * slowness


def test_pieces_of_blocks_give_the_same(monkeypatch):
    import numpy as np

    from graphloom.operators import all_pivots

    edges = np.array(_ladder([1, 2, 3])[:-2])
    n = int(edges[:, :2].max()) + 1
    whole, small = [], (1, 7, 400)
    for at_once in (all_pivots.AT_ONCE, *small):
        monkeypatch.setattr(all_pivots, "AT_ONCE", at_once)
        whole.append(all_pivots.summed_dependencies(n, edges[:, 0], edges[:, 1], edges[:, 2], np.arange(n)))
    assert all(x == pytest.approx(whole[0]) for x in whole) and whole[0].sum() > 0


def test_propagate_and_sampling(spark):
    edges = graph(spark, "1,2 2,3 3,4 5,4")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id bigint")
    hops = bsp.propagate(nodes, edges, F.col("value") + F.col("weight"), F.min, F.least("value", "msg"), F.when(F.col("id") == 1, 0).otherwise(99).cast("bigint"), F.col("new") < F.col("value"))
    assert labels(hops, "value") == {1: 0, 2: 1, 3: 2, 4: 3, 5: 99}
    assert bsp.take_sample(nodes, 3, 7).collect() == bsp.take_sample(nodes.repartition(3), 3, 7).collect()
    top = bsp.top_k(nodes.withColumn("v", F.col("id") % 2), 2, "v")
    assert [r.id for r in top.collect()] == [1, 3]


def test_rounds_that_do_not_suffice_are_an_error(spark):
    path = graph(spark, " ".join(f"{i},{i + 1} {i + 1},{i}" for i in range(1, 7)))
    nodes = path.select(F.col("src").alias("id")).distinct()
    for run in (
        lambda n: leaf.leaf_compression(path, n),
        lambda n: leaf.leaf_folding(path, n),
        lambda n: bsp.propagate(nodes, path, F.col("value"), F.max, F.greatest("value", "msg"), F.col("id"), F.col("new") > F.col("value"), max_rounds=n),
    ):
        with pytest.raises(RuntimeError):
            run(2)
        run(9)


@pytest.fixture
def low_threshold(monkeypatch):
    """Keys of more than five rows are hot."""
    from graphloom import balance

    monkeypatch.setattr(balance.hot_threshold, "__defaults__", (balance.MOST_HOT_KEYS, 5))


def _hubs():
    """Two hubs that share some neighbours, and chains."""
    return " ".join([f"1,{i},{i % 3}" for i in range(2, 30)] + [f"{i},40,2" for i in range(20, 36)] + ["40,41", "41,42", "42,1", "50,51", "51,52"])


@pytest.mark.parametrize("what", ["betweenness", "folding", "neighbors", "lines"])
def test_hubs_above_the_threshold_give_the_same(spark, low_threshold, monkeypatch, what):
    from graphloom import balance
    from graphloom.graph import reverse_duplicated
    from graphloom.sinks import text

    edges = graph(spark, _hubs())

    def run():
        if what == "betweenness":
            out = betweenness.high_betweenness(edges, k=3, batch=12, most_pivots=10).betweenness.select("id", F.round("betweenness", 9))
        elif what == "folding":
            out = leaf.leaf_folding(reverse_duplicated(edges))[1]
        elif what == "neighbors":
            out = neighbors.neighboring_communities(edges)
        else:
            labels = components.components(edges)
            out = text.component_lines(edges, labels).unionByName(text.configurable_edge_lines(edges, labels.withColumnRenamed("component", "value"), write_vertex_value=True, write_edge_value=True))
        return sorted(out.collect(), key=str)

    salted = run()
    monkeypatch.setattr(balance.hot_threshold, "__defaults__", (balance.MOST_HOT_KEYS, 50_000))
    assert salted == run() and salted


def test_loops_go_on_to_the_end_or_raise(spark):
    chain = graph(spark, " ".join(f"{i + 1},{i}" for i in range(12)), str)
    assert {r.component for r in components.components_text(chain).collect() if r.id in ("0", "5")} == {"9"}
    both = graph(spark, " ".join(f"{i},{i + 1} {i + 1},{i}" for i in range(12)))
    for run in (
        lambda: components.components_text(chain, max_rounds=3), lambda: leaf.leaf_compression(both, 2), lambda: leaf.leaf_folding(both, 2),
        lambda: pagerank.pagerank_delta(both, max_rounds=1), lambda: pagerank.pagerank_library(both, max_rounds=1), lambda: pagerank.pagerank_power(both, max_rounds=1),
    ):
        with pytest.raises(RuntimeError):
            run()
    assert leaf.leaf_compression(both).count() == 0


def test_folding_keeps_the_columns_of_edges(spark):
    df = spark.createDataFrame([("a", "b", "x", 1), ("b", "a", "y", 2), ("b", "c", "z", 3), ("c", "b", "q", 4), ("a", "c", "r", 5), ("c", "a", "s", 6), ("d", "a", "t", 7)],
                               "src string, dst string, value string, id int")
    left, nodes = leaf.leaf_folding(df)
    assert left.columns == df.columns and {r.value for r in left.collect()} == set("xyzqrs")
    assert labels(nodes, "value") == {"a": 1, "b": 0, "c": 0}


def test_a_message_loop_halts_by_its_aggregates(spark):
    edges = graph(spark, " ".join(f"{i},{i + 1}" for i in range(20)))
    nodes = spark.range(21)
    seen = []
    out = bsp.propagate(
        nodes, edges, F.col("value"), F.min, F.least("value", "msg"), F.col("id"), F.col("new") < F.col("value"),
        aggregates={"zeros": F.count(F.when(F.col("value") == 0, 1))}, halt=lambda r, m: seen.append((r, m["zeros"])) or m["zeros"] >= 4,
    )
    assert seen == [(0, 2), (1, 3), (2, 4)] and out.filter("value = 0").count() == 4

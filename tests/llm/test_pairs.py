"""Copies hidden by formatting and groups of matches, against brute force."""

import random
import unicodedata
from collections import defaultdict

import pytest

from graphloom.llm import hidden_copies, match_groups


def plain(s):
    return "".join(c for c in s.lower() if unicodedata.category(c)[0] in "LN")


def odd_rows(rng, n):
    base = ["Brim-12", "Ørvan Grün", "0104 Hub", "日本 5", "x", "", "--", None, "n1", "1n", "ab", "ba", "y" * 5000]
    out = []
    for i in range(n):
        pair = [rng.choice(base) for _ in "ab"] if i % 3 else ["0104 hub", "N1"]
        pair = [p if p is None else rng.choice([p, p.upper(), p.replace(" ", "."), f" {p} ", p.replace("-", "")]) for p in pair]
        rng.shuffle(pair)
        out.append((i, *pair, "extra", None))
    return out


SCHEMA = "line_id bigint, c0 string, c1 string, key string, keep_id bigint"


@pytest.mark.parametrize("bounds", [{}, {"least": 20, "most": 10}])
def test_copies_against_brute_force(spark, bounds):
    rows = odd_rows(random.Random(8), 600)
    groups = defaultdict(list)
    for i, a, b, *_ in rows:
        if a and b and plain(a) and plain(b):
            groups[tuple(sorted((plain(a), plain(b))))].append(i)
    want = {(ids[0], i) for ids in groups.values() for i in ids[1:]}
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in hidden_copies.copies(df, **bounds).select("keep_id", "copy_id").collect()]
    assert len(got) == len(want) and set(got) == want
    links = [tuple(r) for r in hidden_copies.collapsed(df, **bounds).select("keep_id", "n_copies").collect()]
    assert len(links) == len(groups) and set(links) == {(v[0], len(v)) for v in groups.values()}
    if not bounds:
        assert hidden_copies.collapsed(df.limit(0)).count() == 0
        assert hidden_copies.copies(df.limit(0)).count() == 0


def brute_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(parent)}


def test_groups_of_chains_rings_hubs_and_cores(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 301), (300, 300), (999, 999)]
    pairs += [(400, 400 + i) for i in range(1, 120)] + [(rng.randrange(600, 640), rng.randrange(600, 640)) for _ in range(130)]
    pairs += [(640 + i, rng.randrange(600, 640 + i)) for i in range(30)] + [(400, 401), (401, 400)]
    df = spark.createDataFrame([*pairs, (None, 1), (2, None)], "a bigint, b bigint")
    want = brute_groups(pairs)
    got = match_groups.groups(df).collect()
    assert len(got) == len(want) and {r.v: r.group for r in got} == want
    assert match_groups.groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_name_groups(spark, dense):
    rows = odd_rows(random.Random(10), 150) + [(1000, "Solo", "solo", "", None), (1001, "zz", "aa", "", None)]
    want = brute_groups([(plain(a), plain(b)) for _, a, b, *_ in rows if a and b and plain(a) and plain(b)])
    got = match_groups.name_groups(spark.createDataFrame(rows, SCHEMA), dense=dense).collect()
    assert len(got) == len(want) and {r.name: r.group_name for r in got} == want


def test_rounds_stay_few_on_a_path_of_rising_degrees(spark):
    """Each vertex of a core points to the next, of higher degree: one local maximum alone."""
    pairs, new = [], 10_000
    for i in range(40):
        pairs.append((i, i + 1))
        for _ in range(3 + i):  # triangles, so that nothing can be stripped or spliced for long
            pairs += [(i, new), (new, new + 1), (new + 1, i), (new + 1, new + 2), (new + 2, new), (new + 2, i)]
            new += 3
    got = {r.v: r.group for r in match_groups.groups(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert set(got.values()) == {0} and len(got) == len({v for p in pairs for v in p})


def test_a_hub_above_the_threshold(spark, monkeypatch):
    import graphloom.balance as balance

    monkeypatch.setattr(balance.hot_threshold, "__defaults__", (balance.MOST_HOT_KEYS, 20))
    rng = random.Random(12)
    pairs = [(0, i) for i in range(1, 150)] + [(rng.randrange(1, 150), rng.randrange(150, 220)) for _ in range(200)] + [(500, 501)]
    got = {r.v: r.group for r in match_groups.groups(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == brute_groups(pairs)

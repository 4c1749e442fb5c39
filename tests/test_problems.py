"""Problems 2, 4 and 5 against brute force, on odd inputs and on the small tables."""

import datetime as dt
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom import balance
from graphloom.functions.names import plain_form
from graphloom.operators import frequency, hierarchy, rowparse

T0 = dt.datetime(2024, 1, 1)


def plain(s):
    return "".join(c for c in s.lower() if unicodedata.category(c)[0] in "LN")


# ---------------------------------------------------------------- names and per-key results
def test_plain_form(spark):
    names = ["A-b C", "", "  ", "--", "ÄÖ ß", "Ωmega ΣΑΣ", "x" * 100_000, "٣ five", "日本-語", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(plain_form("n")).collect()]
    assert got == [None if n is None else plain(n) for n in names]


def test_last_by_plain_name_ties_nulls_and_hot_key(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        name = rng.choice(["Hub 1", "hub-1", "HUB1"]) if i % 2 else rng.choice(["a", "B", None, "", "--", f"n{i % 50}"])
        rows.append((i, name, None if i % 11 == 0 else T0 + dt.timedelta(hours=rng.randrange(20)), "x"))
    df = spark.createDataFrame(rows, "line_id bigint, c0 string, seen_at timestamp, name string")
    want = {}
    for i, name, at, _ in rows:
        if name is not None and plain(name):
            want[plain(name)] = max(want.get(plain(name), (dt.datetime.min, -1)), (at or dt.datetime.min, i))
    got = {r.name: r.line_id for r in frequency.last_by_plain_name(df).collect()}
    assert got == {k: v[1] for k, v in want.items()}
    assert frequency.last_by_plain_name(df.limit(0)).count() == 0


def test_names_report(spark):
    rows = [(1, "A-b", T0), (2, "ab", None), (3, "A-b", None), (4, "AB", T0), (5, "--", T0), (6, None, T0), (7, "c", None)]
    df = spark.createDataFrame(rows, "line_id bigint, c0 string, seen_at timestamp")
    got = {r.name: (r.line_id, r.n, r.n_spellings, r.spelling) for r in frequency.names_report(df).collect()}
    assert got == {"ab": (4, 4, 3, "A-b"), "c": (7, 1, 1, "c")}


def test_profile_and_percentile(spark, monkeypatch):
    monkeypatch.setattr(balance.hot_threshold, "__defaults__", (balance.MOST_HOT_KEYS, 3))
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, -5, 3, 3, 7, -(2**63), 2**63 - 1])) for _ in range(500)] + [("only", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    values = defaultdict(list)
    for k, v in rows:
        if k is not None:
            values[k].append(v)
    got = {r.key: r for r in frequency.key_profile(df, F.col("k"), "v").collect()}
    assert got["only"].n == 1 and got["only"].n_values == 0 and got["only"]["mode"] is None
    for k in ("a", "b"):
        counts = Counter(v for v in values[k] if v is not None)
        most = max(counts.values())
        assert (got[k].n, got[k].n_values, got[k].mode_n) == (len(values[k]), len(counts), most)
        assert got[k]["mode"] == min(v for v, c in counts.items() if c == most)
    low = spark.createDataFrame([("x", -(2**63)), ("x", 5)], "k string, v bigint")
    assert [tuple(r) for r in frequency.key_profile(low, F.col("k"), "v").collect()] == [("x", 2, 2, -(2**63), 1)]
    for q in (0.01, 0.5, 0.9, 1.0):
        got = {r.key: r.percentile for r in frequency.key_percentile(df, F.col("k"), "v", q).collect()}
        for k in ("a", "b"):
            vs = sorted(v for v in values[k] if v is not None)
            assert got[k] == next(v for i, v in enumerate(vs, 1) if i >= q * len(vs) - 1e-9)
        assert "only" not in got


def test_lookup_spreads_hot_keys(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", i) for i in range(900)] + [(1000, None, 0)]
    left = spark.createDataFrame(rows, "id bigint, k string, z bigint")
    right = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 450, 3))], "k string, w bigint")
    out = balance.lookup(left, right, "k", 901, "id", least=50, most=10).collect()
    assert len(out) == 901
    assert {r.id: r.w for r in out} == {i: (1 if k == "hot" else int(k[1:]) if k and int(k[1:]) < 450 else None) for i, k, _ in rows}


# ---------------------------------------------------------------- rows that fail to parse
def brute_reason(line, sep):
    """A character at a time, independent of the patterns: the fields, or the reason and the first broken field."""
    sep = chr(int(sep[2:], 16)) if sep and sep.startswith("\\x") and len(sep) == 4 else sep
    sep = sep if sep is not None and len(sep) == 1 else None
    spaces = [c for c in " \t\r" if c != sep]
    fields, i, line = [], 0, line or ""
    while True:
        j = i
        while j < len(line) and line[j] in spaces:
            j += 1
        if j < len(line) and line[j] == '"':
            j += 1
            value = ""
            while True:
                if j >= len(line):
                    return "quoting", min(4, len(fields) + 1)
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        value += '"'
                        j += 2
                        continue
                    break
                value += line[j]
                j += 1
            j += 1
            while j < len(line) and line[j] in spaces:
                j += 1
            if j < len(line) and line[j] != sep:
                return "quoting", min(4, len(fields) + 1)
        else:
            j = i
            while j < len(line) and line[j] != sep:
                if line[j] == '"':
                    return "quoting", min(4, len(fields) + 1)
                j += 1
            value = line[i:j]
        fields.append(value.strip("".join(spaces)))
        if j >= len(line):
            break
        i = j + 1
    if len(fields) not in (2, 3):
        return "columns", 2 if len(fields) == 1 else 4
    for i, f in enumerate(fields[:2], 1):
        if not f or re.search("[\x00-\x1f\x7f�]", f):
            return "value", i
    if len(fields) == 3 and not (re.fullmatch("-?[0-9]+", fields[2]) and -(2**63) <= int(fields[2]) < 2**63):
        return "value", 3
    return [*fields, None][:3]


def test_parse_rows_against_brute_force(spark):
    rng = random.Random(3)
    seps = [",", ";", "|", "\t", "\\x01", "\x01", " ", "#", "é", "\\x41"]
    fixed = ["", ",", "a,b", "a,b,", "a,b,5,6", ' "a,b" , c , -0012 ', '"a""b",c', '"a"b",c', 'a"b,c', '"a,b', "a,b,9223372036854775807",
             "a,b,9223372036854775808", "a,b,-9223372036854775808", "a,b,-9223372036854775809", "a,b," + "0" * 300 + "7", "a,b,+1", "a,b,1.0", "a,b,0", "a,b,-0", "a,b,000",
             'a,b,"12"', 'a,b," 12 "', '"",b', '" ",b', '"""",b', "a\x00,b", "a�,b", "a,b\n", "a,b,1\n", "x" * 200_000 + ",b", '"' + '""' * 100_000 + '",b',
             "\ta\r,\tb\r", "a,b,-", "a,b,٣"]
    rows = [(line, ",") for line in fixed] + [(None, ","), ("a,b", None), ("a,b", ""), ("a,b", ",,")]
    for _ in range(6000):
        sep = rng.choice(seps)
        real = rowparse.separator(sep) if len(sep) == 4 else sep
        alphabet = [real, real, '"', '"', " ", "a", "7", "-", "\t", "\r", "\n", "�", "\x02", "日"]
        rows.append(("".join(rng.choice(alphabet) for _ in range(rng.randrange(12))), sep))
    data = spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], "id int, line string, delim string, c0 string")
    out = {r.id: r for r in rowparse.parse_rows(data).collect()}
    assert len(out) == len(rows)
    for i, (line, sep) in enumerate(rows):
        want, r = brute_reason(line, sep), out[i]
        assert r._c0 == "kept"
        if isinstance(want, tuple):
            assert (r.reason, r.bad_field, r.c0, r.c1, r.c2) == (*want, None, None, None), (line, sep)
        else:
            assert (r.reason, r.bad_field, r.c0, r.c1, r.c2) == (None, None, want[0], want[1], None if want[2] is None else int(want[2])), (line, sep)
    assert rowparse.parse_rows(data.limit(0)).count() == 0


# ---------------------------------------------------------------- hierarchies
def brute_tree(links):
    parent = {v: (p if p in {x for x, _ in links} and p != v else None) for v, p in links}
    out = {}
    for v in parent:
        way, x = [], v
        while x is not None and x not in way:
            way.append(x)
            x = parent[x]
        out[v] = ("cycle", min(way[way.index(x) :])) if x is not None else tuple(reversed(way))
    return out


@pytest.mark.parametrize("worth", [0.3, 1.1])
def test_hierarchy_against_brute_force(spark, worth, monkeypatch):
    monkeypatch.setattr(hierarchy, "WORTH_PEELING", worth)
    monkeypatch.setattr(balance.hot_threshold, "__defaults__", (balance.MOST_HOT_KEYS, 100))
    rng = random.Random(int(10 * worth))
    links = [(v, rng.choice([None, v, 10_000, rng.randrange(300), max(0, v - 1)])) for v in range(300)]
    links += [(v, v - 1) for v in range(1001, 1060)] + [(1000, None)] + [(2000 + v, 2000 + (v + 1) % 7) for v in range(7)] + [(2100, 2003), (2101, 2100)]
    links += [(5000 + v, 0) for v in range(400)]
    want = brute_tree(links)
    df = spark.createDataFrame([(p, v, v, "x") for v, p in links], "parent bigint, node bigint, size bigint, via string")
    tree = hierarchy.hierarchy(df)
    flat = hierarchy.hierarchy(df, paths=False)
    assert "path" not in flat.columns and sorted(flat.collect(), key=str) == sorted(tree.drop("path").collect(), key=str)
    rows = tree.collect()
    assert len(rows) == len(links)
    below = defaultdict(int)
    for way in want.values():
        if way[0] != "cycle":
            for a in way:
                below[a] += 1
    for r in rows:
        if want[r.node][0] == "cycle":
            assert (r.cycle, r.path, r.depth, r.root, r.subtree) == (want[r.node][1], None, None, None, None)
        else:
            assert (tuple(r.path), r.depth, r.root, r.cycle, r.subtree) == (want[r.node], len(want[r.node]) - 1, want[r.node][0], None, below[r.node])
    pairs = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.descendants(tree).collect()}
    assert pairs == {(a, w[-1], len(w) - 1 - i) for w in want.values() if w[0] != "cycle" for i, a in enumerate(w[:-1])}


def test_a_tall_chain_and_a_large_circle_take_few_rounds(spark, monkeypatch):
    written = []
    table = hierarchy.Scratch.table
    monkeypatch.setattr(hierarchy.Scratch, "table", lambda self, df, name="t", **m: written.append(name) or table(self, df, name, **m))
    n = 400
    links = [(v, v - 1 if v else None) for v in range(n)] + [(n + v, n + (v + 1) % n) for v in range(n)]
    rows = hierarchy.hierarchy(spark.createDataFrame(links, "node bigint, parent bigint"), paths=False).collect()
    assert len(rows) == 2 * n and written.count("marked") < 30
    assert all((r.depth, r.subtree, r.root) == (r.node, n - r.node, 0) for r in rows if r.node < n)
    assert all(r.cycle == n for r in rows if r.node >= n)


def test_hierarchy_of_nothing(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "node bigint, parent bigint")).count() == 0


def test_community_parents(spark):
    rows = [
        (1, 1, "Ann", None, " BOB ", T0), (2, 2, "Bob", -1, "ann", T0), (3, 2, "Bob", -1, None, T0 + dt.timedelta(1)), (4, 3, "bob ", 1, "x", T0),
        (5, 4, None, None, None, None), (6, 4, None, 3, None, None), (7, None, "Q", 1, None, T0), (8, 5, "E", None, "nobody", T0),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, vertex_id bigint, name string, community bigint, communityName string, recorded_at timestamp")
    got = {r.node: r.parent for r in hierarchy.community_parents(df).collect()}
    assert got == {1: 2, 2: None, 3: 1, 4: 3, 5: None}

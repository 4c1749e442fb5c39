"""SQL (DuckDB) of the graph queries. Rounds are written out, each as a materialised part of one query; rounds after
the end of an iteration change nothing."""

from __future__ import annotations

_G = "g AS MATERIALIZED (SELECT src, dst, coalesce(weight, 1) AS weight FROM edges_numeric WHERE src IS NOT NULL AND dst IS NOT NULL)"
_BOTH = "b AS MATERIALIZED (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g)"
_U = """u AS MATERIALIZED (SELECT src, dst FROM (
    SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS src, user_id AS dst FROM events) t WHERE src IS NOT NULL)"""
_NAMES = "n AS MATERIALIZED (SELECT c0 AS src, c1 AS dst, coalesce(c2, 1) AS weight FROM examples WHERE c0 IS NOT NULL AND c1 IS NOT NULL)"
_PARTS = """p AS MATERIALIZED (SELECT src, dst, CAST(sum(w) AS BIGINT) AS weight FROM (
    SELECT id AS src, trim(split_part(x, ':', 1)) AS dst, coalesce(TRY_CAST(nullif(split_part(x, ':', 2), '') AS BIGINT), 1) AS w
    FROM (SELECT id, unnest(string_split(edges, ',')) AS x FROM community_graph) t WHERE trim(x) <> '') t WHERE dst <> '' GROUP BY 1, 2)"""


def _reach(of: str, best: str, key: str = "{}") -> str:
    """Labels spread to a fixpoint: the table holds one label a node, replaced only by a better one."""
    better = ">" if best == "max" else "<"
    a, b = key.format("src"), key.format("dst")
    return f"""
        WITH RECURSIVE {_G}, e AS MATERIALIZED (SELECT DISTINCT {a} AS a, {b} AS b FROM g{' UNION SELECT ' + b + ', ' + a + ' FROM g' if of == 'both' else ''}),
        l(id, component) USING KEY (id) AS (
            SELECT id, {best}(c) FROM (SELECT {a} AS id, {a} AS c FROM g UNION ALL SELECT {b}, {b} FROM g{'' if of == 'both' else ' UNION ALL SELECT ' + a + ', ' + b + ' FROM g'}) t GROUP BY id
          UNION
            SELECT e.b, {best}(l.component) FROM l JOIN e ON e.a = l.id JOIN recurring.l k ON k.id = e.b
            GROUP BY e.b HAVING {best}(l.component) {better} {best}(k.component))
        SELECT id, component FROM l"""


def _leaf(edges: str, rounds: int = 40) -> str:
    parts = [f"e0 AS MATERIALIZED (SELECT src, dst, weight FROM {edges})"]
    for i in range(rounds):
        parts.append(f"k{i} AS MATERIALIZED (SELECT src FROM e{i} GROUP BY src HAVING count(*) > 1)")
        parts.append(f"e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE src IN (SELECT src FROM k{i}) AND dst IN (SELECT src FROM k{i}))")
    return f"WITH {_G}, {_BOTH}, {', '.join(parts)} SELECT src, dst, weight FROM e{rounds}"


_SHARES = """s AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM (SELECT src, dst, count(*) AS n FROM u GROUP BY 1, 2) t),
    v AS MATERIALIZED (SELECT src AS id FROM u UNION SELECT dst FROM u), c AS MATERIALIZED (SELECT count(*) AS n FROM v)"""


def _push(start: str, first: str, delta: float | str, rounds: int = 60) -> str:
    parts = [f"r0 AS MATERIALIZED (SELECT id, CAST({start} AS DOUBLE) AS rank, CAST({first} AS DOUBLE) AS diff FROM v, c)"]
    for i in range(rounds):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT r.id, r.rank + coalesce(m.got, 0) AS rank, m.got AS diff FROM r{i} r LEFT JOIN (
            SELECT dst AS id, 0.85::DOUBLE * sum(diff * share) AS got FROM r{i} JOIN s ON s.src = r{i}.id WHERE diff > {delta} GROUP BY dst) m ON m.id = r.id)""")
    return f"WITH {_U}, {_SHARES}, {', '.join(parts)} SELECT id, round(rank, 6) AS rank FROM r{rounds}"


def _power(rounds: int = 30) -> str:
    parts = ["r0 AS MATERIALIZED (SELECT id, CAST(1.0::DOUBLE / n AS DOUBLE) AS rank, 1.0::DOUBLE AS change FROM v, c)"]
    for i in range(rounds):
        done = f"(SELECT max(change) FROM r{i}) < 0.001" if i >= 2 else "false"
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT id, CASE WHEN {done} THEN rank ELSE fresh END AS rank, CASE WHEN {done} THEN change ELSE abs(fresh - rank) / rank END AS change
            FROM (SELECT r.id, r.rank, r.change, 0.15::DOUBLE / c.n + 0.85::DOUBLE * coalesce(m.got, 0) AS fresh FROM c, r{i} r LEFT JOIN (
            SELECT dst AS id, sum(rank * share) AS got FROM r{i} JOIN s ON s.src = r{i}.id GROUP BY dst) m ON m.id = r.id) t)""")
    return f"WITH {_U}, {_SHARES}, {', '.join(parts)} SELECT id, round(rank, 6) AS rank FROM r{rounds}"


_MERGED = """e AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM g GROUP BY 1, 2),
    a AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
    v0 AS MATERIALIZED (SELECT src AS id, src AS community, sum(weight) AS sigma, sum(weight) AS k, false AS changed FROM a GROUP BY 1),
    t AS MATERIALIZED (SELECT sum(k) AS m FROM v0)"""


def _messages(i: int) -> str:
    return f"""m{i} AS MATERIALIZED (SELECT a.dst AS id, v.community AS c, v.sigma AS c_sigma, sum(a.weight) AS w FROM a JOIN v{i} v ON v.id = a.src GROUP BY 1, 2, 3)"""


def _cycle(i: int) -> str:
    """v(i+1) from v(i)."""
    way = ">" if i % 2 == 0 else "<"
    return f"""{_messages(i)},
    x{i} AS MATERIALIZED (SELECT id, c AS best FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY score DESC, c DESC) AS r FROM (
        SELECT v.id, m.c, CASE WHEN m.c = v.community AND m.c_sigma = v.k THEN 0 ELSE m.w * t.m - v.k * (m.c_sigma - CASE WHEN m.c = v.community THEN v.k ELSE 0 END) END AS score
        FROM m{i} m JOIN v{i} v ON v.id = m.id, t) s WHERE score > 0) s WHERE r = 1),
    y{i} AS MATERIALIZED (SELECT v.id, CASE WHEN v.community {way} x.best THEN x.best ELSE v.community END AS community, v.k, coalesce(v.community {way} x.best, false) AS changed
        FROM v{i} v LEFT JOIN x{i} x ON x.id = v.id),
    v{i + 1} AS MATERIALIZED (SELECT id, community, sum(k) OVER (PARTITION BY community) AS sigma, k, changed FROM y{i})"""


_STATE = "SELECT id, community, CAST(sigma AS BIGINT) AS communitySigmaTot, CAST(0 AS BIGINT) AS internalWeight, CAST(k AS BIGINT) AS nodeWeight"
_LEVEL0 = f"WITH {_G}, {_MERGED}, {', '.join(map(_cycle, range(4)))}"
_BETWEEN = """lab AS MATERIALIZED (SELECT id, community FROM v4),
    z AS MATERIALIZED (SELECT x.community AS cs, y.community AS cd, e.weight FROM e JOIN lab x ON x.id = e.src JOIN lab y ON y.id = e.dst),
    ce AS MATERIALIZED (SELECT least(cs, cd) AS src, greatest(cs, cd) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM z WHERE cs <> cd GROUP BY 1, 2)"""


def _betweenness(depth: int = 8) -> str:
    """Distances and path counts by levels of the search from every node; then pairs through each node."""
    parts = ["e AS MATERIALIZED (SELECT DISTINCT src, dst FROM u WHERE src <> dst)", "p0 AS MATERIALIZED (SELECT id AS s, id AS v, 0 AS d, 1.0::DOUBLE AS n FROM v)"]
    for i in range(depth):
        seen = " UNION ALL ".join(f"SELECT s, v FROM p{j}" for j in range(i + 1))
        parts.append(f"""p{i + 1} AS MATERIALIZED (SELECT p.s, e.dst AS v, {i + 1} AS d, sum(p.n) AS n FROM p{i} p JOIN e ON e.src = p.v
            WHERE NOT EXISTS (SELECT 1 FROM ({seen}) q WHERE q.s = p.s AND q.v = e.dst) GROUP BY 1, 2)""")
    every = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(depth + 1))
    return f"""WITH {_U}, v AS MATERIALIZED (SELECT src AS id FROM u UNION SELECT dst FROM u), {', '.join(parts)}, p AS MATERIALIZED ({every})
        SELECT v.id, round(coalesce(b.b, 0), 6) AS betweenness FROM v LEFT JOIN (
            SELECT x.v AS id, sum(x.n * y.n / z.n) AS b FROM p x JOIN p y ON y.s = x.v JOIN p z ON z.s = x.s AND z.v = y.v
            WHERE x.d > 0 AND y.d > 0 AND z.s <> z.v AND x.d + y.d = z.d GROUP BY 1) b ON b.id = v.id"""


ORACLES = {
    "edge_list": f"WITH {_G} SELECT src, dst, weight FROM g",
    "edge_text_strict": f"WITH {_G} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, weight FROM g",
    "edge_text_numeric": f"WITH {_G} SELECT src, dst, weight FROM g",
    "edge_text_tokens": f"WITH {_G}, {_BOTH} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, weight AS value FROM b",
    "reverse_duplicate_edges": f"WITH {_G}, {_BOTH} SELECT src, dst, weight FROM b",
    "merge_parallel_edges": f"WITH {_G} SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM g GROUP BY 1, 2",
    "distinct_nodes": f"WITH {_G} SELECT src AS id FROM g UNION SELECT dst FROM g",
    "node_dictionary": f"WITH {_NAMES} SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT src AS name FROM n UNION SELECT dst FROM n) t",
    "encoded_edges": f"""WITH {_NAMES}, d AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT src AS name FROM n UNION SELECT dst FROM n) t)
        SELECT x.id AS src, y.id AS dst, n.weight FROM n JOIN d x ON x.name = n.src JOIN d y ON y.name = n.dst""",
    "out_degree": f"WITH {_G} SELECT src AS id, count(*) AS degree FROM g GROUP BY 1",
    "weighted_degree": f"WITH {_G}, {_BOTH} SELECT src AS id, CAST(sum(weight) AS BIGINT) AS weight FROM b GROUP BY 1",
    "subgraph": f"""WITH {_G}, k AS MATERIALIZED (SELECT src FROM g GROUP BY src HAVING count(*) > 1)
        SELECT src, dst, weight FROM g WHERE src IN (SELECT src FROM k) AND dst IN (SELECT src FROM k)""",
    "triplets": f"WITH {_G} SELECT src, dst, weight, count(*) OVER (PARTITION BY src) AS degree FROM g",
    "top_degree": f"WITH {_G}, {_BOTH} SELECT src AS id, CAST(sum(weight) AS BIGINT) AS weight FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "community_edges": f"WITH {_PARTS} SELECT src, dst, weight FROM p",
    "community_states": f"""WITH {_PARTS}, o AS (SELECT id, max(coalesce(internalWeight, 0)) AS iw FROM community_graph GROUP BY 1),
        k AS (SELECT src AS id, sum(weight) AS nw FROM p GROUP BY 1)
        SELECT o.id, CAST(o.iw + coalesce(k.nw, 0) AS BIGINT) AS communitySigmaTot, CAST(o.iw AS BIGINT) AS internalWeight, CAST(coalesce(k.nw, 0) AS BIGINT) AS nodeWeight
        FROM o LEFT JOIN k ON k.id = o.id""",
    "ipv4_round_trip": """SELECT event_id, concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) AS address, n AS back
        FROM (SELECT event_id, (user_id * 7919 + event_id * 104729) % 4294967296 AS n FROM events) t""",
    "nation_trade": """SELECT CAST(s_nationkey AS INTEGER) AS src, CAST(c_nationkey AS INTEGER) AS dst, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
    "part_next_degree": """SELECT l_partkey AS id, count(*) AS degree FROM (
        SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem) t WHERE nxt IS NOT NULL GROUP BY 1""",
    "user_sequence": f"WITH {_U} SELECT src, dst, count(*) AS weight FROM u GROUP BY 1, 2",
    "wcc_max": _reach("both", "max"),
    "wcc_min": _reach("both", "min"),
    "wcc_text": _reach("both", "max", "CAST({} AS VARCHAR)"),
    "wcc_text_directed": _reach("out", "max", "CAST({} AS VARCHAR)"),
    "leaf_compression": _leaf("g"),
    "leaf_compression_both": _leaf("b"),
    "pagerank_delta": _push("1.85::DOUBLE / n", "0.85::DOUBLE / n", 0.001),
    "pagerank_delta_relative": _push("1.85::DOUBLE / n", "0.85::DOUBLE / n", "(SELECT 0.01::DOUBLE / n FROM c)"),
    "pagerank_library": _push("0.15", "0.15", 0.01),
    "pagerank_power": _power(),
    "louvain_initial": f"WITH {_G}, {_MERGED} {_STATE} FROM v0",
    "louvain_messages": f"WITH {_G}, {_MERGED}, {_messages(0)} SELECT id, c, CAST(c_sigma AS BIGINT) AS cSigma, CAST(w AS BIGINT) AS w FROM m0",
    "louvain_best_move": f"WITH {_G}, {_MERGED}, {_cycle(0)} SELECT id, best FROM x0",
    "louvain_one_cycle": f"WITH {_G}, {_MERGED}, {_cycle(0)} {_STATE}, changed FROM v1",
    "louvain_level0": f"{_LEVEL0} {_STATE} FROM v4",
    "louvain_modularity": f"""{_LEVEL0}, {_messages(4)}
        SELECT round(sum(greatest(0, coalesce(m.w, 0) / CAST(t.m AS DOUBLE) - CAST(v.sigma AS DOUBLE) * v.k / (CAST(t.m AS DOUBLE) * t.m))), 9) AS q
        FROM t, v4 v LEFT JOIN m4 m ON m.id = v.id AND m.c = v.community""",
    "louvain_compress": f"""{_LEVEL0}, {_BETWEEN}, i AS (SELECT cs AS id, 2 * sum(weight) AS iw FROM z WHERE cs = cd GROUP BY 1),
        w AS (SELECT id, sum(weight) AS nw FROM (SELECT src AS id, weight FROM ce UNION ALL SELECT dst, weight FROM ce) t GROUP BY 1)
        SELECT l.id, l.id AS community, CAST(coalesce(iw, 0) + coalesce(nw, 0) AS BIGINT) AS communitySigmaTot, CAST(coalesce(iw, 0) AS BIGINT) AS internalWeight,
               CAST(coalesce(nw, 0) AS BIGINT) AS nodeWeight
        FROM (SELECT DISTINCT community AS id FROM lab) l LEFT JOIN i ON i.id = l.id LEFT JOIN w ON w.id = l.id""",
    "louvain_compress_edges": f"{_LEVEL0}, {_BETWEEN} SELECT src, dst, weight FROM ce",
    "community_compression": f"""WITH {_PARTS}, c AS MATERIALIZED (SELECT src, min(dst) AS community FROM p GROUP BY 1),
        q AS MATERIALIZED (SELECT c.community, p.dst AS t, p.weight AS w FROM p JOIN c ON c.src = p.src),
        h AS (SELECT c.community, count(*) + coalesce((SELECT sum(w) FROM q WHERE q.community = c.community AND q.t = c.community), 0) AS weight FROM c GROUP BY 1),
        o AS (SELECT community, t, CAST(sum(w) AS BIGINT) AS w FROM q WHERE t <> community GROUP BY 1, 2)
        SELECT h.community, CAST(h.weight AS BIGINT) AS weight, o.t AS target, o.w FROM h LEFT JOIN o ON o.community = h.community""",
    "betweenness_exact": _betweenness(),
}

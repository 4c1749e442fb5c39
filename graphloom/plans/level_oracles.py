"""SQL (DuckDB) of whole Louvain runs, folding and betweenness, with rounds and levels written out, and of the layouts."""

from __future__ import annotations

from graphloom.plans.graph_oracles import _BOTH, _G, _NAMES, _PARTS, _SHARES, _U, ORACLES as GRAPH, _betweenness, _leaf, _push, _reach

# ---------------------------------------------------------------- Louvain
_E0 = """e0 AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM g GROUP BY 1, 2)"""
_E0_TEXT = """e0 AS MATERIALIZED (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, sum(weight) AS weight FROM b GROUP BY 1, 2)"""


def _level(lv: int, text: bool = False, cycles: int = 4) -> str:
    """Level lv from e{lv} (and, above 0, v{lv}_0) to v{lv}_{cycles} with its modularity q{lv}."""
    v, m, parts = f"v{lv}", f"t{lv}.m", []
    arcs = f"SELECT src, dst, weight FROM e{lv}" + ("" if text else f" UNION ALL SELECT dst, src, weight FROM e{lv}")
    parts.append(f"a{lv} AS MATERIALIZED ({arcs})")
    if lv == 0:
        parts.append(f"{v}_0 AS MATERIALIZED (SELECT src AS id, src AS community, {'0' if text else 'sum(weight)'} AS sigma, sum(weight) AS k, 0 AS iw FROM a0 GROUP BY 1)")
    parts.append(f"t{lv} AS MATERIALIZED (SELECT sum(k + iw) AS m FROM {v}_0)")
    for i in range(cycles):
        way = (">" if i % 2 == 0 else "<") if not text else ("<" if i % 2 == 0 else ">")
        parts.append(f"m{lv}_{i} AS MATERIALIZED (SELECT a.dst AS id, v.community AS c, v.sigma AS cs, sum(a.weight) AS w FROM a{lv} a JOIN {v}_{i} v ON v.id = a.src GROUP BY 1, 2, 3)")
        parts.append(f"""x{lv}_{i} AS MATERIALIZED (SELECT id, c AS best FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY score DESC, c {'ASC' if text else 'DESC'}) AS r FROM (
            SELECT v.id, m.c, CASE WHEN m.c = v.community AND m.cs = v.k + v.iw THEN 0 WHEN m.c = v.community THEN (m.w + v.iw) * {m} - (v.k + v.iw) * (m.cs - v.k - v.iw)
            ELSE m.w * {m} - (v.k + v.iw) * m.cs END AS score FROM m{lv}_{i} m JOIN {v}_{i} v ON v.id = m.id, t{lv}) s WHERE score > 0) s WHERE r = 1)""")
        parts.append(f"""{v}_{i + 1} AS MATERIALIZED (SELECT id, community, sum(k + iw) OVER (PARTITION BY community) AS sigma, k, iw FROM (
            SELECT v.id, CASE WHEN v.community {way} x.best THEN x.best ELSE v.community END AS community, v.k, v.iw FROM {v}_{i} v LEFT JOIN x{lv}_{i} x ON x.id = v.id) y)""")
    end = f"{v}_{cycles}"
    parts.append(f"w{lv} AS MATERIALIZED (SELECT a.dst AS id, v.community AS c, sum(a.weight) AS w FROM a{lv} a JOIN {end} v ON v.id = a.src GROUP BY 1, 2)")
    parts.append(f"""q{lv} AS MATERIALIZED (SELECT coalesce(sum(greatest(0, (v.iw + coalesce(w.w, 0)) / CAST({m} AS DOUBLE) - CAST(v.sigma AS DOUBLE) * (v.k + v.iw) / (CAST({m} AS DOUBLE) * {m}))), 0) AS q
        FROM t{lv}, {end} v LEFT JOIN w{lv} w ON w.id = v.id AND w.c = v.community WHERE v.id IN (SELECT id FROM w{lv}))""")
    return ", ".join(parts)


def _next(lv: int, cycles: int = 4) -> str:
    """The communities of level lv as the vertices and edges of the next."""
    n, v = lv + 1, f"v{lv}_{cycles}"
    return f"""z{n} AS MATERIALIZED (SELECT x.community AS cs, y.community AS cd, e.weight FROM e{lv} e JOIN {v} x ON x.id = e.src JOIN {v} y ON y.id = e.dst),
        e{n} AS MATERIALIZED (SELECT least(cs, cd) AS src, greatest(cs, cd) AS dst, sum(weight) AS weight FROM z{n} WHERE cs <> cd GROUP BY 1, 2),
        i{n} AS MATERIALIZED (SELECT id, sum(w) AS iw FROM (SELECT community AS id, iw AS w FROM {v} UNION ALL SELECT cs, 2 * weight FROM z{n} WHERE cs = cd) t GROUP BY 1),
        k{n} AS MATERIALIZED (SELECT id, sum(weight) AS k FROM (SELECT src AS id, weight FROM e{n} UNION ALL SELECT dst, weight FROM e{n}) t GROUP BY 1),
        v{n}_0 AS MATERIALIZED (SELECT i.id, i.id AS community, coalesce(k, 0) + iw AS sigma, coalesce(k, 0) AS k, iw FROM i{n} i LEFT JOIN k{n} k ON k.id = i.id)"""


#: Levels written out; one more than is kept on the checked tables, where the last must gain too little.
LEVELS = 5


def _run() -> str:
    """All levels with kept, the number of those kept."""
    parts = [_G, _E0]
    for lv in range(LEVELS):
        parts += [_level(lv), *([_next(lv)] if lv + 1 < LEVELS else [])]
    gains = " ".join(f"WHEN q{lv}.q <= q{lv - 1}.q + 0.001 THEN {lv}" for lv in range(1, LEVELS))
    parts.append(f"kept AS MATERIALIZED (SELECT CASE {gains} ELSE {LEVELS} END AS n FROM {', '.join(f'q{lv}' for lv in range(LEVELS))})")
    chain = "".join(f" LEFT JOIN v{lv}_4 l{lv} ON l{lv}.id = l{lv - 1}.community" for lv in range(1, LEVELS))
    columns = ", ".join(f"CASE WHEN n > {lv} THEN l{lv}.community END AS c{lv}" for lv in range(LEVELS))
    parts.append(f"d AS MATERIALIZED (SELECT l0.id, n, {columns} FROM kept, v0_4 l0{chain})")
    parts.append(f"lab AS MATERIALIZED (SELECT id, coalesce({', '.join(f'c{lv}' for lv in reversed(range(LEVELS)))}) AS community FROM d)")
    return ", ".join(parts)


_RUN = _run()
_COMPONENTS = _reach("both", "max").split("WITH RECURSIVE", 1)[1].split("SELECT id, component FROM l")[0].split(_G + ",", 1)[1].replace("e AS MATERIALIZED", "ee AS MATERIALIZED").replace("JOIN e ON e.a", "JOIN ee ON ee.a").replace("e.b", "ee.b")
_BORDERS = f"""WITH RECURSIVE {_RUN}, {_COMPONENTS},
    n AS (SELECT g.src, x.community AS sc, g.dst, y.community AS dc, l.component FROM g JOIN lab x ON x.id = g.src JOIN lab y ON y.id = g.dst JOIN l ON l.id = g.src)"""
_TEXT = f"{_G}, {_BOTH}, {_E0_TEXT}, {_level(0, text=True)}"


# ---------------------------------------------------------------- folding
def _fold(rounds: int = 60) -> str:
    parts = [f"f0 AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM b GROUP BY 1, 2)", "n0 AS MATERIALIZED (SELECT id, 0 AS value FROM (SELECT src AS id FROM g UNION SELECT dst FROM g) t)"]
    for i in range(rounds):
        parts.append(f"s{i} AS MATERIALIZED (SELECT s.id, s.dst, n.value FROM (SELECT src AS id, any_value(dst) AS dst FROM f{i} GROUP BY src HAVING count(*) = 1) s JOIN n{i} n ON n.id = s.id)")
        parts.append(f"""n{i + 1} AS MATERIALIZED (SELECT n.id, n.value + coalesce(h.gain, 0) AS value FROM n{i} n
            LEFT JOIN (SELECT dst AS id, sum(value + 1) AS gain FROM s{i} GROUP BY 1) h ON h.id = n.id WHERE n.id NOT IN (SELECT id FROM s{i}))""")
        parts.append(f"""f{i + 1} AS MATERIALIZED (SELECT f.* FROM f{i} f WHERE f.src NOT IN (SELECT id FROM s{i})
            AND NOT EXISTS (SELECT 1 FROM s{i} s WHERE s.dst = f.src AND s.id = f.dst))""")
    return f"WITH {_G}, {_BOTH}, {', '.join(parts)}, left_edges AS (SELECT * FROM f{rounds}), left_nodes AS (SELECT id, CAST(value AS BIGINT) AS value FROM n{rounds})"


_FOLD = _fold()


# ---------------------------------------------------------------- betweenness
def _pivots(batches: int = 2, size: int = 6) -> str:
    """The pivots of the first batches: the least hashes of id and batch among those not used."""
    parts = []
    for i in range(batches):
        used = " UNION ALL ".join(f"SELECT id FROM y{j}" for j in range(i))
        rest = f" WHERE id NOT IN ({used})" if used else ""
        parts.append(f"y{i} AS MATERIALIZED (SELECT id FROM v{rest} ORDER BY md5(id || ':{i}'), id LIMIT {size})")
    return ", ".join(parts) + f", pivots AS MATERIALIZED ({' UNION ALL '.join(f'SELECT id FROM y{i}' for i in range(batches))})"


_EXACT = _betweenness()
_AT = _EXACT.rindex("SELECT v.id, round(")
_HIGH = f"""{_EXACT[:_AT].rstrip()}, {_pivots()}, h AS MATERIALIZED (SELECT v.id, coalesce(b.b, 0) AS betweenness FROM v LEFT JOIN (
    SELECT x.v AS id, sum(x.n * y.n / z.n) AS b FROM p x JOIN p y ON y.s = x.v JOIN p z ON z.s = x.s AND z.v = y.v
    WHERE x.s IN (SELECT id FROM pivots) AND x.d > 0 AND y.d > 0 AND z.s <> z.v AND x.d + y.d = z.d GROUP BY 1) b ON b.id = v.id),
    top AS (SELECT id, betweenness FROM h ORDER BY round(betweenness, 9) DESC, id LIMIT 10)"""
#: One predecessor a vertex and pivot: what depends on a vertex are those below it in the tree.
_ONE = f"""{_EXACT[:_AT].rstrip().replace('WITH ', 'WITH RECURSIVE ', 1)}, tree AS MATERIALIZED (SELECT y.s, y.v, max(e.src) AS pred FROM p y JOIN e ON e.dst = y.v JOIN p x ON x.s = y.s AND x.v = e.src AND x.d + 1 = y.d
        GROUP BY 1, 2),
    above(s, v, a) AS (SELECT s, v, pred FROM tree UNION ALL SELECT o.s, o.v, t.pred FROM above o JOIN tree t ON t.s = o.s AND t.v = o.a)
    SELECT v.id, CAST(count(o.a) AS DOUBLE) AS betweenness FROM v LEFT JOIN above o ON o.a = v.id AND o.a <> o.s GROUP BY v.id"""


def _lengths(depth: int = 24) -> str:
    """Betweenness where edges have lengths: distances by relaxation, path counts by distance, then pairs through a node."""
    parts = []
    for i in range(1, depth + 1):
        parts.append(f"""c{i} AS MATERIALIZED (SELECT y.s, y.v, y.d, sum(x.n) AS n FROM far y JOIN w ON w.dst = y.v JOIN ({' UNION ALL '.join(f'SELECT * FROM c{j}' for j in range(i))}) x
            ON x.s = y.s AND x.v = w.src AND x.d + w.w = y.d WHERE y.d = {i} GROUP BY 1, 2, 3)""")
    every = " UNION ALL ".join(f"SELECT * FROM c{j}" for j in range(depth + 1))
    return f"""WITH RECURSIVE {_U}, w AS MATERIALIZED (SELECT src, dst, greatest(1, least(3, count(*)) - 1) AS w FROM u WHERE src <> dst GROUP BY 1, 2),
        v AS MATERIALIZED (SELECT src AS id FROM u UNION SELECT dst FROM u),
        far(s, v, d) USING KEY (s, v) AS (SELECT id, id, 0 FROM v UNION
            SELECT f.s, w.dst, min(f.d + w.w) FROM far f JOIN w ON w.src = f.v LEFT JOIN recurring.far k ON k.s = f.s AND k.v = w.dst
            GROUP BY f.s, w.dst HAVING min(f.d + w.w) < coalesce(min(k.d), 1000000)),
        c0 AS MATERIALIZED (SELECT s, v, d, 1.0::DOUBLE AS n FROM far WHERE d = 0), {', '.join(parts)}, p AS MATERIALIZED ({every})
        SELECT v.id, round(coalesce(b.b, 0), 6) AS betweenness FROM v LEFT JOIN (
            SELECT x.v AS id, sum(x.n * y.n / z.n) AS b FROM p x JOIN p y ON y.s = x.v JOIN p z ON z.s = x.s AND z.v = y.v
            WHERE x.d > 0 AND y.d > 0 AND z.s <> z.v AND x.d + y.d = z.d GROUP BY 1) b ON b.id = v.id"""


_LIBRARY = _push("0.15", "0.15", 0.01)
_RANKS = _LIBRARY[: _LIBRARY.rindex("SELECT id, round(")] + "{} FROM (" + _LIBRARY[_LIBRARY.rindex("SELECT id, round(") :] + ") r"
_CORE = _leaf("b")

ORACLES = {
    "leaf_compression_sequence": _leaf("u1").replace(_G, f"{_G}, {_U}, u1 AS MATERIALIZED (SELECT src, dst, 1 AS weight FROM u)", 1),
    "leaf_fold": f"{_FOLD} SELECT id, value FROM left_nodes",
    "louvain_labels": f"WITH {_RUN} SELECT id, community FROM lab",
    "louvain_dendrogram": f"WITH {_RUN} " + " UNION ALL ".join(f"SELECT id, {lv} AS level, c{lv} AS community FROM d WHERE c{lv} IS NOT NULL" for lv in range(LEVELS)),
    "louvain_level_q": f"WITH {_RUN} " + " UNION ALL ".join(f"SELECT {lv} AS level, round(q, 9) AS q FROM q{lv}, kept WHERE n > {lv}" for lv in range(LEVELS)),
    "louvain_text": f"WITH {_TEXT} SELECT id, community FROM v0_4",
    "neighboring_communities": f"{_BORDERS} SELECT src, sc AS src_community, dst, dc AS dst_community, component, sc <> dc AS crosses FROM n",
    "hbse_topk": f"{_HIGH} SELECT id, round(betweenness, 6) AS betweenness FROM top",
    "betweenness_one_path": _ONE,
    "betweenness_lengths": _lengths(),
    "sink_edges": _CORE.replace("SELECT src, dst, weight FROM e40", "SELECT src || ',' || dst AS value FROM e40"),
    "sink_components": f"{GRAPH['wcc_max'].split('SELECT id, component FROM l')[0]} SELECT concat_ws(chr(9), g.src, g.dst, l.component) AS value FROM g JOIN l ON l.id = g.src",
    "sink_ranks": _RANKS.format("SELECT id || '|' || rank AS value"),
    "sink_tab_vertices": _RANKS.format("SELECT id || chr(9) || rank AS value"),
    "sink_betweenness": f"{_HIGH} SELECT id || ',' || round(betweenness, 4) AS value FROM h",
    "sink_betweenness_set": f"{_HIGH} SELECT CAST(id AS VARCHAR) AS value FROM top",
    "sink_betweenness_stats": f"""WITH {_U}, v AS (SELECT src AS id FROM u UNION SELECT dst FROM u)
        SELECT unnest(['set_size,10', 'stability,0', 'stability_counter,5', 'pivot_limit,10', 'batch,6', 'pivots_selected,12', 'pivots_percent,' || 100.0::DOUBLE * 12 / count(*), 'cycles,2']) AS value FROM v""",
    "sink_level_vertices": f"""WITH {_RUN} SELECT '(' || id || ',{{name:' || id || ',community:' || community || ',communityName:' || community || ',communitySigmaTot:' || CAST(sigma AS BIGINT)
        || ',internalWeight:0,nodeWeight:' || CAST(k AS BIGINT) || '}})' AS value FROM v0_4""",
    "sink_level_edges": f"WITH {_RUN} SELECT 'Edge(' || src || ',' || dst || ',' || CAST(weight AS BIGINT) || ')' AS value FROM e0",
    "sink_q_values": f"WITH {_RUN} " + " UNION ALL ".join(f"SELECT '({lv},' || round(q, 6) || ')' AS value FROM q{lv}, kept WHERE n > {lv}" for lv in range(LEVELS)),
    "sink_neighbors": f"{_BORDERS} SELECT src || ':' || sc || ',' || dst || ':' || dc || ',' || component || ',' || (sc <> dc) AS value FROM n",
    "sink_folded_edges": f"{_FOLD} SELECT f.src || ';' || f.dst || ';' || n.value || ';' || CAST(f.weight AS BIGINT) AS value FROM left_edges f JOIN left_nodes n ON n.id = f.src",
    "sink_community_vertices": f"""WITH {_TEXT} SELECT concat_ws(chr(9), v.id, v.community, '0', (SELECT string_agg(e.dst || ':' || CAST(e.weight AS BIGINT), ',' ORDER BY e.dst) FROM e0 e WHERE e.src = v.id)) AS value
        FROM v0_4 v""",
    "sink_dendrogram": f"WITH {_RUN} SELECT concat_ws(chr(9), id, {', '.join(f'c{lv}' for lv in range(LEVELS))}) AS value FROM d",
    "edge_text_values": """WITH r AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, coalesce('w' || weight, 'none') AS value FROM edges_numeric WHERE src IS NOT NULL AND dst IS NOT NULL)
        SELECT src, dst, value FROM r UNION ALL SELECT dst, src, value FROM r""",
    "edge_text_ignored_values": f"WITH {_G} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(7 AS BIGINT) AS value FROM g",
    "edge_text_addresses": f"WITH {_G} SELECT src * 7919 % 4294967296 AS src, dst * 7919 % 4294967296 AS dst, CAST(1 AS BIGINT) AS weight FROM g",
    "names_as_seen": """SELECT name, row_number() OVER (ORDER BY seen) - 1 AS id FROM (
        SELECT name, min(seen) AS seen FROM (SELECT c0 AS name, line_id * 2 AS seen FROM examples UNION ALL SELECT c1, line_id * 2 + 1 FROM examples) t WHERE name IS NOT NULL GROUP BY name) t""",
    "community_lines": GRAPH["community_states"],
    "spread_in": f"""
        WITH RECURSIVE {_G}, e AS MATERIALIZED (SELECT DISTINCT dst AS a, src AS b FROM g),
        l(id, component) USING KEY (id) AS (
            SELECT id, id FROM (SELECT src AS id FROM g UNION SELECT dst FROM g) t
          UNION
            SELECT e.b, max(l.component) FROM l JOIN e ON e.a = l.id JOIN recurring.l k ON k.id = e.b GROUP BY e.b HAVING max(l.component) > max(k.component))
        SELECT id, component FROM l""",
    "spread_either": GRAPH["wcc_max"],
    "node_sample": f"WITH {_G} SELECT id FROM (SELECT src AS id FROM g UNION SELECT dst FROM g) t ORDER BY md5(id || ':5'), id LIMIT 100",
}

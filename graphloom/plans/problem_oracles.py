"""SQL (DuckDB) of the queries of the general problems."""

from __future__ import annotations

PLAIN = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_C0 = PLAIN.format("c0")



def _patterns(sep: str) -> tuple[str, str, str, str]:
    """Spaces, any soundly quoted field, a valid name and a number of one separator, in plain (non-possessive) form."""
    spaces = "".join(f"\\x{ord(c):02x}" for c in " \t\r" if c != sep)
    at, bad = f"\\x{ord(sep):02x}", r"\x00-\x1f\x7f\x{fffd}"
    some = f'(?:[{spaces}]*"(?:[^"]|"")*"[{spaces}]*|[^"{at}]*)'
    plain, quoted = f'[^"{at}{bad}]', f'(?:[^"{bad}]|"")'
    bare, marked = f'[^" {at}{bad}]', f'(?:[^" {bad}]|"")'
    name = f'(?:[{spaces}]*{bare}(?:{plain}*{bare})?[{spaces}]*|[{spaces}]*"[{spaces}]*{marked}(?:{quoted}*{marked})?[{spaces}]*"[{spaces}]*)'
    number = f'(?:[{spaces}]*-?[0-9]+[{spaces}]*|[{spaces}]*"[{spaces}]*-?[0-9]+[{spaces}]*"[{spaces}]*)'
    return at, some, name, number


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _is(pattern: str) -> str:
    return f"regexp_matches(line, {_quoted(f'^(?:{pattern})$')}, 's')"


def _starts(pattern: str) -> str:
    return f"regexp_matches(line, {_quoted(f'^(?:{pattern})')}, 's')"


def _valid(sep: str) -> str:
    at, _, name, number = _patterns(sep)
    return f"({_is(f'{name}[{at}]{name}')} OR ({_is(f'{name}[{at}]{name}[{at}]{number}')} AND TRY_CAST({_field(sep, 3)} AS BIGINT) IS NOT NULL))"


def _field(sep: str, i: int) -> str:
    """The i-th field of a valid row, freed of its quotes and outer spaces."""
    at, _, name, number = _patterns(sep)
    spaces = "||".join(f"chr({ord(c)})" for c in " \t\r" if c != sep)
    parts = [name, name, number]
    parts[i - 1] = f"({parts[i - 1]})"
    whole = f"[{at}]".join(parts[: max(i, 2)]) + (f"(?:[{at}]{number})?" if i < 3 else "")
    bare = f"trim(regexp_extract(line, {_quoted(f'^{whole}$')}, 1, 's'), {spaces})"
    return f"CASE WHEN {bare} LIKE '\"%' THEN trim(replace(substr({bare}, 2, length({bare}) - 2), '\"\"', '\"'), {spaces}) ELSE {bare} END"


def _rows(sep: str) -> str:
    at, some, _, _ = _patterns(sep)
    return f"""CASE WHEN NOT {_is(f'{some}(?:[{at}]{some})*')} THEN 'quoting' WHEN NOT {_is(f'{some}(?:[{at}]{some}){{1,2}}')} THEN 'columns'
        WHEN {_valid(sep)} THEN NULL ELSE 'value' END"""


def _bad_field(sep: str) -> str:
    """The first broken field of a failing row, by its reason."""
    at, some, name, _ = _patterns(sep)
    sound = lambda n: _starts(f"[{at}]".join([some] * n) + f"(?:[{at}]|$)")
    good = lambda n: _starts(f"[{at}]".join([name] * n) + f"(?:[{at}]|$)")
    return f"""CASE reason WHEN 'quoting' THEN CASE WHEN NOT {sound(1)} THEN 1 WHEN NOT {sound(2)} THEN 2 WHEN NOT {sound(3)} THEN 3 ELSE 4 END
        WHEN 'columns' THEN CASE WHEN {_is(some)} THEN 2 ELSE 4 END ELSE CASE WHEN NOT {good(1)} THEN 1 WHEN NOT {good(2)} THEN 2 ELSE 3 END END"""


_DELIMS = {",": ",", ";": ";", "|": "|", "\t": "\t", "\\x01": "\x01"}


def _by_delim(make) -> str:
    return "CASE " + " ".join(f"WHEN delim = {'chr(9)' if d == chr(9) else repr(d).replace(chr(92) * 2, chr(92))} THEN {make(s)}" for d, s in _DELIMS.items()) + " END"


_REASON = _by_delim(_rows)
_FAILED = f"f AS MATERIALIZED (SELECT raw_id, delim, line, {_REASON} AS reason FROM examples_raw)"

_TREE = """
    last AS MATERIALIZED (SELECT vertex_id, lower(trim(name)) AS own, community, lower(trim(communityName)) AS of FROM (
        SELECT *, row_number() OVER (PARTITION BY vertex_id ORDER BY recorded_at DESC NULLS LAST, row_id DESC) AS k FROM louvaindata WHERE vertex_id IS NOT NULL) t WHERE k = 1),
    named AS MATERIALIZED (SELECT own, min(vertex_id) AS id FROM last WHERE own IS NOT NULL GROUP BY own),
    up AS MATERIALIZED (SELECT l.vertex_id AS id, CASE WHEN coalesce(d.vertex_id, n.id) <> l.vertex_id THEN coalesce(d.vertex_id, n.id) END AS parent FROM last l
        LEFT JOIN last d ON d.vertex_id = l.community AND l.community <> -1
        LEFT JOIN named n ON n.own = l.of AND coalesce(l.community, -1) = -1),
    down(id, path) AS (SELECT id, CAST(id AS VARCHAR) FROM up WHERE parent IS NULL UNION ALL SELECT u.id, d.path || '/' || u.id FROM up u JOIN down d ON d.id = u.parent),
    lost AS MATERIALIZED (SELECT id, parent FROM up WHERE id NOT IN (SELECT id FROM down)),
    over(id, a) AS (SELECT id, parent FROM lost UNION SELECT o.id, l.parent FROM over o JOIN lost l ON l.id = o.a),
    ring AS (SELECT o.id, min(o.a) AS cycle FROM over o WHERE o.a IN (SELECT id FROM over WHERE id = a) GROUP BY o.id)"""
_TREE = _TREE.replace(" over(", " above(").replace("FROM over ", "FROM above ")

ORACLES = {
    "p2_found": f"""
        SELECT name, line_id FROM (
            SELECT {_C0} AS name, line_id,
                   row_number() OVER (PARTITION BY {_C0} ORDER BY seen_at DESC NULLS LAST, line_id DESC) AS k
            FROM examples WHERE c0 IS NOT NULL) t
        WHERE k = 1 AND name <> ''""",
    "p2_report": f"""
        WITH r AS (SELECT {_C0} AS name, c0 AS spelling, seen_at, line_id FROM examples WHERE c0 IS NOT NULL),
        v AS (SELECT name, spelling, count(*) AS n FROM r WHERE name <> '' GROUP BY 1, 2),
        l AS (SELECT name, line_id, row_number() OVER (PARTITION BY name ORDER BY seen_at DESC NULLS LAST, line_id DESC) AS k FROM r WHERE name <> ''),
        s AS (SELECT name, spelling, row_number() OVER (PARTITION BY name ORDER BY n DESC, spelling) AS k FROM v),
        t AS (SELECT name, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_spellings FROM v GROUP BY name)
        SELECT t.name, l.line_id, t.n, t.n_spellings, s.spelling FROM t JOIN l ON l.name = t.name AND l.k = 1 JOIN s ON s.name = t.name AND s.k = 1""",
    "p2_profile": f"""
        WITH v AS (SELECT {_C0} AS name, c2, count(*) AS n FROM examples WHERE c0 IS NOT NULL GROUP BY 1, 2),
        m AS (SELECT name, c2, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, c2) AS k FROM v WHERE c2 IS NOT NULL)
        SELECT t.name, t.n, t.n_values, m.c2 AS mode, m.n AS mode_n
        FROM (SELECT name, CAST(sum(n) AS BIGINT) AS n, count(c2) AS n_values FROM v WHERE name <> '' GROUP BY name) t
        LEFT JOIN m ON m.name = t.name AND m.k = 1""",
    "p2_median": f"""
        SELECT name, quantile_disc(c2, 0.5) AS median FROM (SELECT {_C0} AS name, c2 FROM examples WHERE c0 IS NOT NULL AND c2 IS NOT NULL) t
        WHERE name <> '' GROUP BY name""",
    "p4_found": f"WITH {_FAILED} SELECT raw_id, reason FROM f WHERE reason IS NOT NULL",
    "p4_broken": f"WITH {_FAILED} SELECT raw_id, {_by_delim(_bad_field)} AS bad_field, reason FROM f WHERE reason IS NOT NULL",
    "p4_loaded": f"""WITH {_FAILED} SELECT raw_id, {_by_delim(lambda s: _field(s, 1))} AS c0, {_by_delim(lambda s: _field(s, 2))} AS c1,
        TRY_CAST({_by_delim(lambda s: _field(s, 3))} AS BIGINT) AS c2 FROM f WHERE reason IS NULL""",
    "p5_found": f"""WITH RECURSIVE {_TREE}
        SELECT id AS vertex_id, path FROM down UNION ALL SELECT id, 'cycle ' || cycle FROM ring""",
    "p5_tree": f"""WITH RECURSIVE {_TREE}, w AS MATERIALIZED (SELECT id, [CAST(x AS BIGINT) FOR x IN string_split(path, '/')] AS way FROM down),
        s AS (SELECT a, count(*) AS n FROM (SELECT unnest(way) AS a FROM w) t GROUP BY a)
        SELECT w.id AS vertex_id, w.way[1] AS root, CAST(len(w.way) - 1 AS INTEGER) AS depth, s.n AS subtree, CAST(NULL AS BIGINT) AS cycle FROM w JOIN s ON s.a = w.id
        UNION ALL SELECT id, NULL, NULL, NULL, cycle FROM ring""",
    "p5_descendants": f"""WITH RECURSIVE {_TREE}, w AS (SELECT id, [CAST(x AS BIGINT) FOR x IN string_split(path, '/')] AS way FROM down),
        x AS (SELECT id, way, unnest(generate_series(1, len(way) - 1)) AS i FROM w)
        SELECT way[i] AS ancestor, id AS descendant, CAST(len(way) - i AS INTEGER) AS distance FROM x""",
}

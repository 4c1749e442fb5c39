"""Loading delimited rows, with a reason for every row that fails.

A schema (two names and an optional 64-bit weight) and a separator give one anchored pattern for valid rows. Rows that
do not match it pass through patterns of growing field prefixes, which find the first broken field and with it the reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators of the files known here; any other single character works as well, by the slower general way.
SEPARATORS = (",", ";", "|", "\t", "\x01")
_CONTROL = r"\x00-\x1F\x7F�"
_MOST = 2**63 - 1


def separator(delim: str) -> str:
    """``\\x01``-style notation to its character; anything else is itself."""
    return chr(int(delim[2:], 16)) if delim.startswith("\\x") else delim


def _in_class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def _up_to(most: int) -> str:
    """A pattern for digits, after leading zeros, of a number not above most."""
    digits = str(most)
    alternatives = [f"[0-9]{{1,{len(digits) - 1}}}"]
    for i, d in enumerate(digits):
        if d != "0":
            alternatives.append(f"{digits[:i]}[0-{int(d) - 1}][0-9]{{{len(digits) - i - 1}}}")
    some = f"(?:{'|'.join([*alternatives, digits])})"
    return f"(?:0++{some}?|{some})"


@dataclass(frozen=True)
class Grammar:
    """The patterns of one separator. All repetitions are possessive, so they never backtrack or recurse."""

    sep: str

    @property
    def spaces(self) -> str:
        return _in_class("".join(c for c in " \t\r" if c != self.sep))

    @property
    def field(self) -> str:
        """Any field with sound quoting."""
        s = f"[{self.spaces}]*+"
        return f'(?:{s}"[^"]*+(?:""[^"]*+)*+"{s}|[^"{_in_class(self.sep)}]*+)'

    @property
    def name(self) -> str:
        """A field that is not empty and holds no control character once quotes and outer spaces are gone."""
        s, sep = f"[{self.spaces}]*+", _in_class(self.sep)
        inner = "" if self.sep == " " else "(?: ++{0}++)*+"
        plain, quoted = f'[^" {sep}{_CONTROL}]', f'(?:[^" {_CONTROL}]|"")'
        if self.sep == " ":
            quoted = f'(?:[^"{_CONTROL}]|"")'
        return f'(?:{s}{plain}++{inner.format(plain)}{s}|{s}"{s}{quoted}++{inner.format(quoted)}{s}"{s})'

    @property
    def weight(self) -> str:
        """An integer of 64 signed bits."""
        s = f"[{self.spaces}]*+"
        number = f"(?:-{_up_to(_MOST + 1)}|{_up_to(_MOST)})"
        return f'(?:{s}{number}{s}|{s}"{s}{number}{s}"{s})'

    @property
    def row(self) -> str:
        """Whole valid rows."""
        sep = f"[{_in_class(self.sep)}]"
        return rf"\A({self.name}){sep}({self.name})(?:{sep}({self.weight}))?\z"

    @property
    def quoting(self) -> str:
        """Whole rows of any number of fields with sound quoting."""
        return rf"\A{self.field}(?:[{_in_class(self.sep)}]{self.field})*+\z"

    def _fields(self, n: int) -> str:
        return f"[{_in_class(self.sep)}]".join([self.field] * n)

    def whole(self, n: int) -> str:
        """Whole rows of n fields with sound quoting."""
        return rf"\A{self._fields(n)}\z"

    def sound(self, n: int) -> str:
        """Rows whose first n fields have sound quoting and are followed by another field or the end."""
        return rf"\A{self._fields(n)}(?:[{_in_class(self.sep)}]|\z)"

    def prefix(self, good: int) -> str:
        """Rows whose first ``good`` fields are valid and followed by another field or the end."""
        sep = f"[{_in_class(self.sep)}]"
        fields = [self.name, self.name, self.weight][:good]
        return rf"\A{sep.join(fields)}(?:{sep}|\z)" if fields else r"\A"


#: Stands in patterns for a separator that only the row knows, and for none at all.
_ANY, _NONE = "\uE000", "\uFFFF"


def parse_rows(df: DataFrame, line: str = "line", delim: str = "delim", separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """df with ``c0``, ``c1``, ``c2`` of the valid rows, else ``reason`` and ``bad_field`` (from 1).

    The reason is the first that applies of ``quoting``, ``columns`` and ``value``. bad_field is the first field with
    broken quoting (4: the fourth or a later one), the one that is missing (2) or too many (4), or the first with an
    invalid value: where the growing prefixes of the row stop matching. A null line counts as an empty one;
    a null or unusable separator (not one character) leaves one field, so its rows fail. Columns of df whose names
    clash with the new ones are kept under a leading underscore. One narrow pass, no shuffle.
    """
    new = {"c0", "c1", "c2", "reason", "bad_field", "gl_sep", "gl_ok", "gl_w", "gl_bad"}
    taken = {c.lower() for c in df.columns} | new
    for c in df.columns:
        if c.lower() in new:
            to = f"_{c}"
            while to.lower() in taken:
                to = f"_{to}"
            taken.add(to.lower())
            df = df.withColumnRenamed(c, to)
            line, delim = (to if x == c else x for x in (line, delim))
    text, raw, sep = F.coalesce(F.col(line), F.lit("")), F.col(delim), F.col("gl_sep")
    written = F.char(F.conv(F.substring(raw, 3, 2), 16, 10).cast("bigint"))
    usable = F.when(raw.rlike(r"\A\\x[0-9A-Fa-f]{2}\z"), written).when(F.length(raw) == 1, raw)
    known = dict.fromkeys([*map(separator, separators), " ", "\r"])

    def by_sep(make) -> Column:
        """make(pattern maker) for the row's separator."""
        chosen = F
        for s in known:
            chosen = chosen.when(sep == s, make(lambda f, s=s: F.lit(f(Grammar(s)))))
        return chosen.otherwise(
            make(lambda f: F.replace(F.lit(f(Grammar(_ANY))), F.lit(_in_class(_ANY)), F.concat(F.lit("\\x{"), F.lower(F.hex(F.expr("ascii(gl_sep)"))), F.lit("}"))))
        )

    def matches(f) -> Column:
        return by_sep(lambda pattern: F.regexp_like(text, pattern(f)))

    def group(i: int) -> Column:
        """The i-th field of a valid row, freed of outer spaces and quotes."""
        part = by_sep(lambda pattern: F.call_function("regexp_extract", text, pattern(lambda g: g.row), F.lit(i)))
        chars = F.replace(F.lit(" \t\r"), sep, F.lit(""))
        bare = F.btrim(part, chars)
        inner = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(bare, F.lit('"')), F.btrim(inner, chars)).otherwise(bare)

    out = df.withColumn("gl_sep", F.coalesce(usable, F.lit(_NONE)))
    out = out.withColumn("gl_ok", matches(lambda g: g.row))
    ok = F.col("gl_ok")
    # the first field with broken quoting; then whether a field is missing or too many; then the first broken value
    whole = [matches(lambda g, n=n: g.whole(n)) for n in (1, 2, 3)]
    unsound = F.when(~matches(lambda g: g.sound(1)), 1).when(~matches(lambda g: g.sound(2)), 2).when(~matches(lambda g: g.sound(3)), 3)
    unsound = F.when(~(whole[0] | whole[1] | whole[2]), F.coalesce(unsound, F.when(~matches(lambda g: g.quoting), 4)))
    value = F.when(~matches(lambda g: g.prefix(1)), 1).when(~matches(lambda g: g.prefix(2)), 2).otherwise(3)
    columns = F.when(whole[0], 2).when(~(whole[1] | whole[2]), 4)
    out = out.withColumn("gl_bad", F.when(~ok, F.coalesce(unsound * 10 + 1, columns * 10 + 2, value * 10 + 3)))
    reason = F.element_at(F.array(*map(F.lit, ("quoting", "columns", "value"))), F.col("gl_bad") % 10)
    return (
        out.withColumns({"c0": F.when(ok, group(1)), "c1": F.when(ok, group(2)), "gl_w": F.when(ok, group(3))})
        .withColumn("c2", F.when(F.col("gl_w") != "", F.col("gl_w").cast("bigint")))
        .withColumns({"reason": F.when(~ok, reason), "bad_field": F.floor(F.col("gl_bad") / 10).cast("int")})
        .drop("gl_sep", "gl_ok", "gl_w", "gl_bad")
    )

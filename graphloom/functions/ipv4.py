"""IPv4 addresses as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ipv4_to_long(address: Column | str, strict: bool = False) -> Column:
    """The address as a bigint; anything else is null, or an error with ``strict``."""
    text = F.col(address) if isinstance(address, str) else address
    parts = [F.regexp_extract(text, rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$", i).cast("bigint") for i in range(1, 5)]
    number = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    good = F.regexp_like(text, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
    wrong = F.raise_error(F.concat(F.lit("not an IPv4 address: "), text)) if strict else F.lit(None)
    return F.when(text.isNull(), None).when(good, number).otherwise(wrong.cast("bigint"))


def long_to_ipv4(number: Column | str) -> Column:
    """The dotted form of a bigint from 0 to 2**32 - 1; anything else is null."""
    n = F.col(number) if isinstance(number, str) else number
    parts = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when((n >= 0) & (n < 2**32), F.concat_ws(".", *parts))

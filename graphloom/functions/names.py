"""Forms of names under which they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_form(name: Column | str) -> Column:
    """The name in lower case with everything but letters and digits of any script removed; null stays null.

    Very long names are handled whole; a name without any letter or digit gives the empty string.
    """
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def folded_name(name: Column | str) -> Column:
    """The name without outer blanks, in lower case."""
    return F.lower(F.trim(name))

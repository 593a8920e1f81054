"""String basics shared by the text functions.

Python's idea of white space (``str.isspace``) is wider than that of Java's
``\\s`` or Spark's ``trim``; posts carry no-break and ideographic spaces, so
the set is named once and used everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: every character ``str.isspace`` accepts
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

#: opens a pattern whose classes follow Unicode, as Python's do
UNICODE = "(?U)"
#: the same characters as ``SPACES`` in such a pattern; much faster than ranges
SPACE_CLASS = r"\s\x1C-\x1F"
SPACE = f"[{SPACE_CLASS}]"
NON_SPACE = f"[^{SPACE_CLASS}]"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` names it.

    The optimizer copies expressions when it merges projections or pushes a
    filter down, so steps that each test their input before working on it
    would otherwise grow without bound when chained.
    """
    # by way of a lambda, so that f may have options behind its column
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def chain(c: Column, steps: Iterable[Callable[[Column], Column]]) -> Column:
    """Steps applied one after the other."""
    for step in steps:
        c = let(c, step)
    return c


def strip(c: Column) -> Column:
    """Both ends trimmed of all white space."""

    def trimmed(x: Column) -> Column:
        # trimming walks the whole text, so look at its two ends first
        spaces = F.lit(SPACES)
        padded = spaces.contains(F.left(x, F.lit(1))) | spaces.contains(F.right(x, F.lit(1)))
        return F.when(padded, F.btrim(x, spaces)).otherwise(x)

    return let(c, trimmed)


def words(c: Column) -> Column:
    """White-space separated words; blank text gives an empty array."""
    return F.filter(F.split(c, f"{UNICODE}{SPACE}+"), lambda w: w != "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends trimmed."""
    blanks = F.regexp_replace(c, f"{UNICODE}[{SPACE_CLASS}&&[^ ]]", " ")
    return strip(F.regexp_replace(blanks, " {2,}", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def min_length(c: Column, n: int, trimmed: bool = False) -> Column:
    """Text of at least ``n`` characters; null is not."""
    return F.coalesce(F.length(strip(c) if trimmed else c) >= n, F.lit(False))

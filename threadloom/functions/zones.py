"""Wall-clock times of a zone that name two instants, or none.

Where clocks go back, an hour of the day comes twice; where they go forward, one
is left out. The zone's changes are read from the engine's own rules, so what is
detected is just what its conversions would decide in silence. They are kept by
year, so a time is compared with the few changes of its own year.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.strings import let

#: changes are looked up in these years; a time outside of them is converted unseen
FIRST_YEAR, LAST_YEAR = 1900, 2100
AMBIGUOUS, NON_EXISTENT = "ambiguous", "non-existent"
POLICIES = ("raise", "null", "earlier", "later")
MICROS = 1_000_000


class Change(NamedTuple):
    """Wall-clock seconds from ``start`` up to ``stop``, and the offsets from UTC before and after."""

    start: int
    stop: int
    before: int
    after: int


def clock_changes(spark: SparkSession, zone: str) -> list[Change]:
    """All changes of a zone's clocks from the first year to the last, in order."""
    time = spark._jvm.java.time
    rules = time.ZoneId.of(zone).getRules()
    at = time.Instant.parse(f"{FIRST_YEAR}-01-01T00:00:00Z")
    changes = []
    while (t := rules.nextTransition(at)) is not None:
        at = t.getInstant()
        second, before, after = at.getEpochSecond(), t.getOffsetBefore().getTotalSeconds(), t.getOffsetAfter().getTotalSeconds()
        if second >= _second(LAST_YEAR + 1):
            break
        changes.append(Change(second + min(before, after), second + max(before, after), before, after))
    return changes


@functools.cache
def _second(year: int) -> int:
    import calendar

    return calendar.timegm((year, 1, 1, 0, 0, 0))


def _by_year(changes: list[Change]) -> Column:
    """Per year, its changes as structs."""
    kind = "array<struct<start:bigint,stop:bigint,least:bigint,most:bigint,twice:boolean>>"
    years = []
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        # a change in the night of a new year belongs to both
        own = [c for c in changes if c.start < _second(year + 1) and c.stop > _second(year)]
        structs = [
            f"struct({c.start * MICROS}L AS start, {c.stop * MICROS}L AS stop, {min(c.before, c.after) * MICROS}L AS least, "
            f"{max(c.before, c.after) * MICROS}L AS most, {str(c.before > c.after).lower()} AS twice)"
            for c in own
        ]
        years.append(f"CAST(array({', '.join(structs)}) AS {kind})")
    return F.expr(f"array({', '.join(years)})")


def _change_at(local: Column, changes: list[Change], use: Callable[[Column, Column], Column]) -> Column:
    """``use(change, micros)`` with the change that a naive time falls into, or null."""

    def of(micros: Column) -> Column:
        own = F.get(_by_year(changes), F.year(local) - FIRST_YEAR)
        met = F.filter(own, lambda c: (micros >= c["start"]) & (micros < c["stop"]))
        return let(F.get(met, F.lit(0)), lambda change: use(change, micros))

    return let(F.unix_micros(local.cast("timestamp")), of)


def clock_problem(local: Column, changes: list[Change]) -> Column:
    """``ambiguous``, ``non-existent`` or null for a naive time of the zone."""

    def named(change: Column, _: Column) -> Column:
        return F.when(change.isNotNull(), F.when(change["twice"], AMBIGUOUS).otherwise(NON_EXISTENT))

    return _change_at(local, changes, named)


def local_to_utc(local: Column, zone: str, changes: list[Change], on_change: str = "raise") -> Column:
    """Naive UTC of a naive time of the zone.

    A time that names two instants, or none, is an error, null, or the earlier
    or later of the instants that the two offsets around the change give.
    """
    if on_change not in POLICIES:
        raise ValueError(f"unknown policy: {on_change!r}")

    def resolved(change: Column, micros: Column) -> Column:
        if on_change == "raise":
            problem = F.when(change["twice"], AMBIGUOUS).otherwise(NON_EXISTENT)
            told = F.concat(problem, F.lit(f" time in {zone}: "), F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
            special = F.raise_error(told).cast("timestamp")
        elif on_change == "null":
            special = F.lit(None).cast("timestamp")
        else:
            special = F.timestamp_micros(micros - change["most" if on_change == "earlier" else "least"])
        return F.when(change.isNotNull(), special).otherwise(F.to_utc_timestamp(local.cast("timestamp"), zone))

    return _change_at(local, changes, resolved)

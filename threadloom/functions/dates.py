"""Date and time columns. Timestamps are naive UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_FORMAT = "yyyy-MM-dd HH"
SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Strptime directives and the Spark pattern letters that mean the same.
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%j": "DDD",
    "%z": "xx",
    "%%": "%",
}

# Sampling frequencies by their data-frame alias, as truncation units.
FREQUENCIES = {
    "min": "minute",
    "T": "minute",
    "H": "hour",
    "h": "hour",
    "D": "day",
    "W": "week",
    "M": "month",
    "ME": "month",
    "Q": "quarter",
    "Y": "year",
}


def spark_pattern(fmt: str) -> str:
    """Turn a strptime format into a Spark pattern; a Spark pattern passes through."""
    if "%" not in fmt:
        return fmt
    out, i = [], 0
    while i < len(fmt):
        piece = fmt[i : i + 2]
        if piece in DIRECTIVES:
            out.append(DIRECTIVES[piece])
            i += 2
        else:
            letter = fmt[i]
            out.append(f"'{letter}'" if letter.isalpha() else letter)
            i += 1
    return "".join(out)


def to_time(c: Column, *formats: str) -> Column:
    """Timestamp of a column; what no format reads becomes null."""
    tries = [c.try_cast("timestamp")]
    tries += [F.try_to_timestamp(c.cast("string"), F.lit(spark_pattern(f))) for f in formats]
    return F.coalesce(*tries)


def parse_time(c: Column, fmt: str = SECOND_FORMAT) -> Column:
    """Text in one given format to a timestamp, null when it does not fit."""
    return F.try_to_timestamp(c, F.lit(spark_pattern(fmt)))


def format_time(c: Column, fmt: str = SECOND_FORMAT) -> Column:
    """Timestamp to text; null stays null."""
    return F.date_format(c, spark_pattern(fmt))


def time_text(c: Column) -> Column:
    """Timestamp to text, with six digits of a second only where it has a fraction."""
    whole = F.date_format(c, SECOND_FORMAT)
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))


def local_to_utc(c: Column, zone: str = "America/New_York") -> Column:
    """Wall-clock time of ``zone`` to naive UTC."""
    return F.to_utc_timestamp(c, zone)


def shift(c: Column, *, days: int = 0, hours: int = 0) -> Column:
    """Move a timestamp forward (or back, with negative amounts)."""
    return c + F.make_dt_interval(F.lit(days), F.lit(hours))


def floor_hour(c: Column) -> Column:
    return F.date_trunc("hour", c)


def hour_key(c: Column) -> Column:
    return F.date_format(floor_hour(c), HOUR_FORMAT)


def bucket(c: Column, freq: str = "H") -> Column:
    """Start of the sampling bucket a timestamp falls in."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency: {freq!r}")
    return F.date_trunc(FREQUENCIES[freq], c)


def without_utc_suffix(c: Column) -> Column:
    """Drop a literal ``+00:00``."""
    return F.replace(c, F.lit("+00:00"), F.lit(""))


def in_range(c: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Inclusive range test with open ends; a null date is outside every range."""
    inside = c.isNotNull()
    if start is not None:
        inside = inside & (start.isNull() | (c >= start))
    if end is not None:
        inside = inside & (end.isNull() | (c <= end))
    return F.coalesce(inside, F.lit(False))

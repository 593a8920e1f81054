"""Seeded row order. ``md5(seed | key)`` shuffles rows the same way on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_mark(df: DataFrame) -> Column:
    """Sixteen hex digits of a hash of all columns, nulls included.

    Behind a key's digest it makes the order of rows total: rows that still tie
    are alike in every column, so it does not matter which of them is meant.
    """
    parts = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        hashable = isinstance(field.dataType, T.AtomicType)
        parts += [c.isNull(), c if hashable else c.cast("string")]
    return F.lower(F.lpad(F.hex(F.xxhash64(*parts)), 16, "0"))


def row_digest(df: DataFrame, key: str | list[str], seed: int | str) -> Column:
    """The key's seeded digest, then the row's mark: a total order of rows."""
    return F.concat(row_hash(key, seed), row_mark(df))


def row_hash(key: str | list[str], seed: int | str) -> Column:
    """Hex digest of the seed and the row key."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_fraction(digest: Column) -> Column:
    """The digest as a number in [0, 1), from its first 48 bits (exact in a double)."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") / F.lit(
        float(1 << 48)
    )


def hash_bin(digest: Column) -> Column:
    """Order-keeping bin of a digest, whose width grows with its value.

    The bin is the digest's leading zeros and the two digits after them, so the
    bin that holds the m-th smallest of any number of digests has at most about
    m/16 of them. Bins compare as text in the order of their digests.
    """
    zeros = F.length(digest) - F.length(F.ltrim(digest, F.lit("0")))
    return F.substring(digest, F.lit(1), zeros + 2)

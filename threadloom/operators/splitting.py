"""Disjoint subsets of equal size.

A split needs each row's place in one global order. Rows are dealt out by
ranges of that order and stored; a row's place is then its place within its
part and the sizes of the parts before, of which there are as many as shuffle
partitions. The order is total: a seeded digest of the key, a hash of the whole
row, and a salt that parts rows alike in every column, so a key or a row that
holds most of the table is still dealt out to many tasks.

``key`` orders rows and need not name them: it may repeat and may be null.
Every row is placed once, and subsets have exactly their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.hashing import hash_fraction, row_digest, row_hash
from threadloom.operators.ordering import numbered
from threadloom.session import store
from threadloom.sizing import broadcast_measured

Key = str | list[str]


def subset_size(rows: int, fraction: float | None, size: int | None) -> int:
    """Rows per subset from exactly one of the two ways to say it."""
    if fraction is not None and size is not None:
        raise ValueError("give either a fraction or a size, not both")
    if fraction is None and size is None:
        raise ValueError("give a fraction or a size")
    size = int(rows * fraction) if size is None else int(size)
    if size <= 0:
        raise ValueError("a subset would have no rows")
    return size


def plain_split(
    df: DataFrame,
    key: Key,
    fraction: float | None = None,
    size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Shuffled subsets of exactly ``size`` rows, numbered from 0; the rest is dropped."""
    rows = df.count()
    size = subset_size(rows, fraction, size)
    placed = numbered(df.withColumn("_digest", row_digest(df, key, seed)), ["_digest"])
    split = placed.withColumn("split_id", F.floor(F.col("_place") / size))
    return split.filter(F.col("split_id") < rows // size).select(*df.columns, "split_id")


def _phase(seed: int) -> Column:
    """Where in its share of the order a stratum's row lies: a place of the stratum's own.

    At one place for all, small strata would crowd one subset.
    """
    return hash_fraction(row_hash("_stratum", f"{seed}/phase"))


def stratified_split(
    df: DataFrame,
    stratify_col: str,
    key: Key,
    fraction: float | None = None,
    size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Disjoint subsets in which every stratum has its share; the rest is the last.

    Null is a stratum. Rows are spread evenly over the order by their rank in
    their stratum. Ranking works on digests alone; full rows are stored once
    under a number and move once, in the join that adds ``split_id``.
    """
    if stratify_col not in df.columns:
        raise ValueError(f"no column {stratify_col!r}")
    size = subset_size(df.count(), fraction, size)

    # the stratum as text with a mark, so that null is a value of its own
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratify_col).cast("string")), F.lit(""))
    own = store(
        df.select(
            F.struct(*df.columns).alias("_own"),
            stratum.alias("_stratum"),
            row_digest(df, key, seed).alias("_digest"),
            F.monotonically_increasing_id().alias("_id"),
        )
    )
    ranked = numbered(own.select("_stratum", "_digest", "_id"), ["_stratum", "_digest"])
    strata = ranked.groupBy("_stratum").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    ranked = ranked.join(broadcast_measured(strata), "_stratum")
    rank = F.col("_place") - F.col("_first") + 1
    spread = ranked.select("_id", "_digest", ((rank - _phase(seed)) / F.col("_rows")).alias("_share"))
    placed = numbered(spread, ["_share", "_digest"])
    split = placed.select("_id", F.floor(F.col("_place") / size).alias("split_id"))
    return own.select("_own", "_id").join(split, "_id").select("_own.*", "split_id")


def split_dataframe(
    df: DataFrame,
    key: Key,
    fraction: float | None = None,
    size: int | None = None,
    stratify_col: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Stratified where a column is given, plain otherwise."""
    if stratify_col is None:
        return plain_split(df, key, fraction, size, seed)
    return stratified_split(df, stratify_col, key, fraction, size, seed)

"""Reproducible samples.

Every sample here is "the m smallest seeded hashes of each group", with m
computed per group. Rows are never collected by group: one narrow pass counts
hashes in bins per group, which tells the bin where the m-th hash lies; a
second narrow pass counts only the hashes inside that bin and finds the m-th
itself; the last pass keeps rows up to that hash, with no shuffle of the rows.
A group that holds a third of all rows costs no task more than its bin, about
m/16 hashes.

``key`` names the column, or columns, by which rows are hashed. It may repeat
and may be null: behind its digest stands a hash of the whole row, and rows that
are alike in every column are counted off, so a sample has exactly its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import dates
from threadloom.functions.hashing import hash_bin, row_digest
from threadloom.operators.times import standardize_time
from threadloom.sizing import BROADCAST_ROWS, measure

Key = str | list[str]
#: adds ``quota`` to a frame of (group columns, bin, rows, group_rows)
Quota = Callable[[DataFrame], DataFrame]

#: samples of at most this many rows are found by one ordered limit
LIMIT_ROWS = 100_000


def _cutoffs(
    df: DataFrame, by: list[str], digest: Column, quota: Quota, max_groups: int | None
) -> DataFrame:
    """Per group the largest digest to keep, ``cutoff``, and how many rows of it, ``take``.

    Groups with nothing to keep are absent. ``max_groups`` is a proven bound on
    the groups that keep rows. Where there is none the groups are measured.
    Small results are marked for broadcast.
    """
    hashes = df.select(*by, digest.alias("digest"))
    hashes = hashes.withColumn("bin", hash_bin(F.col("digest")))
    bins = hashes.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("rows"))
    # a group has under two thousand bins, so windows over them stay small
    group = W.partitionBy(*by)
    counted = quota(bins.withColumn("group_rows", F.sum("rows").over(group)))
    edge = _edge(counted.filter(F.col("quota") > 0), by, "bin", "quota")
    edge = edge.select(*by, "bin", F.col("take").alias("need"))
    if max_groups is None:
        edge, fits = measure(edge)
    else:
        fits = max_groups <= BROADCAST_ROWS
    inside = hashes.join(F.broadcast(edge) if fits else edge, [*by, "bin"])
    # equal digests are counted before they meet
    inside = inside.groupBy(*by, "need", "digest").agg(F.count(F.lit(1)).alias("rows"))
    cut = _edge(inside, by, "digest", "need").select(*by, F.col("digest").alias("cutoff"), "take")
    return F.broadcast(cut) if fits else cut


def _edge(counts: DataFrame, by: list[str], order: str, need: str) -> DataFrame:
    """The place in each group's order where ``need`` rows are reached, and ``take``, its share."""
    upto = F.sum("rows").over(W.partitionBy(*by).orderBy(order))
    before = F.col("upto") - F.col("rows")
    reached = counts.withColumn("upto", upto).filter(
        (F.col("upto") >= F.col(need)) & (before < F.col(need))
    )
    return reached.withColumn("take", F.col(need) - before)


def _keep(
    df: DataFrame, by: list[str], digest: Column, quota: Quota, max_groups: int | None
) -> DataFrame:
    """Rows up to their group's cutoff; rows with a null group are never kept."""
    cut = _cutoffs(df, by, digest, quota, max_groups)
    kept = df.withColumn("_digest", digest).join(cut, by).filter(F.col("_digest") <= F.col("cutoff"))
    return _counted_off(kept, df.columns, by)


def _counted_off(kept: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """The kept rows, of which those at the cutoff are as many as it takes.

    Rows of one digest are alike, so they are counted and written out again;
    only the sample is shuffled, and a much repeated row is one per task.
    """
    alike = kept.groupBy(*by, "_digest").agg(
        F.first(F.struct(*columns)).alias("_row"),
        F.count(F.lit(1)).alias("_rows"),
        F.first(F.when(F.col("_digest") == F.col("cutoff"), F.col("take"))).alias("_take"),
    )
    times = F.sequence(F.lit(1), F.coalesce("_take", "_rows"))
    return alike.select("_row", F.explode(times)).select("_row.*")


def reservoir_sample(df: DataFrame, k: int, key: Key, seed: int | str = 42) -> DataFrame:
    """``k`` rows, each set of k equally likely; all rows where there are fewer."""
    if k <= 0:
        return df.limit(0)
    if k <= LIMIT_ROWS:
        # the same total order, a heap of k rows per task
        ordered = df.withColumn("_digest", row_digest(df, key, seed)).orderBy("_digest")
        return ordered.limit(k).drop("_digest")
    everything = df.withColumn("_all", F.lit(0))
    quota: Quota = lambda g: g.withColumn("quota", F.least(F.lit(k), F.col("group_rows")))
    return _keep(everything, ["_all"], row_digest(df, key, seed), quota, 1).drop("_all")


def _cut_to(df: DataFrame, k: int, key: Key, seed: int) -> DataFrame:
    """At most ``k`` rows, by an order of its own; no change to a smaller sample."""
    return reservoir_sample(df, k, key, f"{seed}/cut")


def sample_by_time(
    df: DataFrame, time_col: str, k: int, key: Key, freq: str = "H", seed: int = 42
) -> DataFrame:
    """The same fraction of each time bucket, ``min(1, k/N)``, rounded half to even.

    N counts all rows; rows without a time are in no bucket. A rounded total
    above k is cut to k.
    """
    timed = df.withColumn("_bucket", dates.bucket(F.col(time_col), freq))
    timed = timed.filter(F.col("_bucket").isNotNull())
    rows = df.count()
    fraction = min(1.0, k / max(1, rows))

    def quota(groups: DataFrame) -> DataFrame:
        share = F.bround(F.lit(fraction) * F.col("group_rows"))
        return groups.withColumn("quota", share.cast("long"))

    # a bucket takes a row only if it has N/2k rows or more, so fewer than 2k do
    kept = _keep(timed, ["_bucket"], row_digest(df, key, seed), quota, 2 * k)
    return _cut_to(kept.drop("_bucket"), k, key, seed)


def sample_by_strata(
    df: DataFrame, strata_col: str, k: int, key: Key, seed: int = 42, cut: bool = True
) -> DataFrame:
    """The same number of rows, ``k // strata``, of each stratum, or all it has.

    Null counts as a stratum but gives no rows; with fewer than one row per
    stratum the sample is empty.
    """
    if strata_col not in df.columns:
        raise ValueError(f"no column {strata_col!r}")

    share = k // max(1, df.select(strata_col).distinct().count())
    if share == 0:
        return df.limit(0)
    quota: Quota = lambda g: g.withColumn("quota", F.least(F.col("group_rows"), F.lit(share)))

    # with more than k strata nothing is taken
    kept = _keep(df, [strata_col], row_digest(df, key, seed), quota, k)
    return _cut_to(kept, k, key, seed) if cut else kept


def sample_by_time_and_strata(
    df: DataFrame,
    time_col: str | None,
    strata_col: str | None,
    k: int,
    key: Key,
    freq: str = "H",
    seed: int = 42,
) -> DataFrame:
    """In each time bucket ``k // strata there`` rows of each stratum; cut to k."""
    if not time_col or not strata_col:
        raise ValueError("both a time and a strata column are needed")
    if strata_col not in df.columns:
        raise ValueError(f"no column {strata_col!r}")
    timed = df.withColumn("_bucket", dates.bucket(F.col(time_col), freq))
    timed = timed.filter(F.col("_bucket").isNotNull())

    def quota(groups: DataFrame) -> DataFrame:
        shares = (
            timed.select("_bucket", strata_col)
            .distinct()
            .groupBy("_bucket")
            .agg(F.floor(F.lit(k) / F.count(F.lit(1))).alias("share"))
        )
        shared = groups.join(shares.filter(F.col("share") > 0), "_bucket")
        return shared.withColumn("quota", F.least(F.col("group_rows"), F.col("share")))

    kept = _keep(timed, ["_bucket", strata_col], row_digest(df, key, seed), quota, None)
    return _cut_to(kept.drop("_bucket"), k, key, seed)


def stratified_sample(
    df: DataFrame,
    k: int,
    key: Key,
    time_col: str | None = None,
    strata_col: str | None = None,
    filter_date: str | None = None,
    freq: str = "H",
    seed: int = 42,
) -> DataFrame:
    """The sampling entry: filter and parse the time, then choose by what is given.

    A strata column given as the text ``None`` counts as absent.
    """
    strata = None if strata_col in (None, "", "None") else strata_col
    df = standardize_time(df, time_col, filter_date)
    if time_col and strata:
        return sample_by_time_and_strata(df, time_col, strata, k, key, freq, seed)
    if time_col:
        return sample_by_time(df, time_col, k, key, freq, seed)
    if strata:
        return sample_by_strata(df, strata, k, key, seed)
    return reservoir_sample(df, k, key, seed)

"""What threads do over time: activity, lifetime, replies, references.

A thread, or an hour of it, may hold a large part of all posts, so nothing here
sorts one in a single task: counts are by thread and hour, and posts are compared
in blocks of one global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import POST_REFERENCE
from threadloom.operators.ordering import numbered

#: posts in one block of the global order
GAP_BLOCK = 100_000

# How far back the windows of a report reach, in hours.
LOOKBACKS = {"24h": 24, "72h": 72, "7d": 7 * 24, "30d": 30 * 24}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _span_seconds(time_col: str) -> Column:
    return (_micros(F.max(time_col)) - _micros(F.min(time_col))) / 1e6


def activity(
    df: DataFrame, thread_col: str = "thread_id", time_col: str = "posted_date_time",
    text_col: str = "text",
) -> DataFrame:
    """Posts, characters and characters per minute of each thread.

    A thread of one instant has no rate.
    """
    chars = F.sum(F.length(text_col))
    return df.groupBy(thread_col).agg(
        F.count(F.lit(1)).alias("posts"),
        chars.alias("chars"),
        F.try_divide(chars, _span_seconds(time_col) / 60.0).alias("chars_per_minute"),
    )


def lifetime(
    df: DataFrame, thread_col: str = "thread_id", time_col: str = "posted_date_time"
) -> DataFrame:
    """First and last post of each thread and the seconds between them."""
    return df.groupBy(thread_col).agg(
        F.min(time_col).alias("first_post"),
        F.max(time_col).alias("last_post"),
        _span_seconds(time_col).alias("lifetime_seconds"),
    )


def reply_gaps(
    df: DataFrame, key: str, thread_col: str = "thread_id", time_col: str = "posted_date_time",
    block: int = GAP_BLOCK,
) -> DataFrame:
    """Seconds since the thread's previous post; null for its first.

    Posts get a place in the order of thread, time and key, and are compared
    with the one before in blocks of that order. The last post of a block enters
    the next as a row of its own. So neither a thread nor an hour of it, however
    busy, is one task's.
    """
    timed = df.filter(F.col(time_col).isNotNull())
    placed = numbered(timed, [thread_col, time_col, key])
    at = F.floor(F.col("_place") / block)
    ends = placed.filter((F.col("_place") + 1) % block == 0)
    carried = ends.select(
        thread_col, time_col, "_place", (at + 1).alias("_block"), F.lit(True).alias("_carried")
    )
    rows = placed.withColumns({"_block": at, "_carried": F.lit(False)})
    rows = rows.unionByName(carried, allowMissingColumns=True)
    order = W.partitionBy("_block").orderBy("_place")
    same = F.lag(thread_col).over(order).eqNullSafe(F.col(thread_col))
    gap = (_micros(F.col(time_col)) - _micros(F.lag(time_col).over(order))) / 1e6
    return (
        rows.withColumn("gap_seconds", F.when(same, gap))
        .filter(~F.col("_carried"))
        .select(*df.columns, "gap_seconds")
    )


def hourly_frequency(
    df: DataFrame, thread_col: str = "thread_id", time_col: str = "posted_date_time",
    burst: float = 2.0,
) -> DataFrame:
    """Posts per thread and hour, the thread's mean of them, and whether an hour
    has ``burst`` times the mean or more."""
    hour = F.date_trunc("hour", F.col(time_col).cast("timestamp"))
    counts = df.groupBy(thread_col, hour.alias("hour")).agg(F.count(F.lit(1)).alias("posts"))
    # one row per hour of a thread, so a thread's window is short
    mean = F.avg("posts").over(W.partitionBy(thread_col))
    return counts.withColumn("mean_posts", mean).withColumn(
        "burst", F.col("posts") >= burst * F.col("mean_posts")
    )


def references(df: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """One row per ``>>id`` in the raw text; must come before cleaning."""
    ids = F.regexp_extract_all(F.col(text_col), F.lit(POST_REFERENCE.replace(r"\d+", r"(\d+)")))
    return df.select(*keep, F.explode(ids).alias("ref"))


def reach(df: DataFrame, thread_col: str = "thread_id", text_col: str = "text") -> DataFrame:
    """Distinct references made in each thread."""
    return references(df, text_col, thread_col).groupBy(thread_col).agg(
        F.count_distinct("ref").alias("reach")
    )


def impact(df: DataFrame, thread_col: str = "thread_id", text_col: str = "text") -> DataFrame:
    """Number of other threads that refer to each thread; uncited threads have 0.

    References are reduced to distinct pairs and counted before they meet the
    thread table, so a much cited thread is one row in the join.
    """
    thread = F.col(thread_col).cast("string")
    pairs = references(df.withColumn("_citing", thread), text_col, "_citing").distinct()
    cited = (
        pairs.filter(F.col("ref") != F.col("_citing"))
        .groupBy("ref")
        .agg(F.count(F.lit(1)).alias("impact"))
    )
    threads = df.select(thread_col).distinct()
    return threads.join(cited, threads[thread_col].cast("string") == cited["ref"], "left").select(
        thread_col, F.coalesce("impact", F.lit(0)).alias("impact")
    )


def lookbacks(
    df: DataFrame, time_col: str = "posted_date_time", *by: str
) -> DataFrame:
    """Posts within each lookback window of the latest post of the table."""
    latest = df.agg(F.max(time_col)).scalar()
    counts = [
        F.count_if(F.col(time_col) >= latest - F.make_dt_interval(F.lit(0), F.lit(h))).alias(
            f"posts_{name}"
        )
        for name, h in LOOKBACKS.items()
    ]
    return df.groupBy(*by).agg(*counts)

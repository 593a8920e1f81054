"""Broadcasts happen only behind a size that is known or has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


#: up to this estimate, an input may sit in fewer pieces than there are cores
SMALL_INPUT_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores before costly row work.

    A small table is often one file with one row group, which is one task. A
    large one has pieces enough, and is not shuffled.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` when the caller can prove it has at most ``max_rows`` rows."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df


def measure(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` stored, and whether it is small enough to broadcast."""
    stored = materialise(df)
    width = F.sum(F.octet_length(F.to_json(F.struct(*stored.columns))))
    rows, size = stored.agg(F.count(F.lit(1)), F.coalesce(width, F.lit(0))).first()
    return stored, rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def broadcast_measured(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it turns out small.

    A larger frame is returned without a hint, so the join is a shuffled one
    in which adaptive execution splits skewed partitions.
    """
    stored, fits = measure(df)
    return F.broadcast(stored) if fits else stored

"""Places in one global order, without a task that sorts or holds it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.session import materialise

#: ``monotonically_increasing_id`` has the partition above these bits
PART_BITS = 33


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` stored in order, with ``_place`` from 0 up and without gaps.

    Rows are dealt out by ranges of the order. A salt behind it parts rows that
    tie, so a value that most rows share is still dealt out to many tasks. A
    row's place is its place in its part and the sizes of the parts before.
    """
    salt = F.xxhash64(F.monotonically_increasing_id())
    dealt = df.withColumn("_salt", salt).repartitionByRange(*order, "_salt")
    dealt = dealt.sortWithinPartitions(*order, "_salt").drop("_salt")
    rows = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PART_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per shuffle partition
    before = F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")
    firsts = F.broadcast(sizes.select("_part", before.alias("_before")))
    within = F.col("_at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    placed = rows.withColumn("_part", part).join(firsts, "_part")
    return placed.withColumn("_place", F.col("_before") + within).drop("_part", "_before", "_at")

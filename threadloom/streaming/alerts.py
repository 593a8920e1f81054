"""Alerts on a stream of scores or step events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.metrics import DEFAULT_RULES, evaluate_rules


def alert_stream(scores: DataFrame, rules: Sequence[tuple] = tuple(DEFAULT_RULES)) -> DataFrame:
    """Rule checks, row by row; works on a stream as on a table."""
    return evaluate_rules(scores, rules)


def windowed_error_rate(
    steps: DataFrame, window: str = "1 hour", lateness: str = "10 minutes",
    time_col: str = "ts", failed_col: str = "failed",
) -> DataFrame:
    """Error rate per tumbling window; rows later than the watermark are dropped."""
    total = F.count(F.lit(1))
    failed = F.sum(F.col(failed_col).cast("int"))
    return (
        steps.withWatermark(time_col, lateness)
        .groupBy(F.window(time_col, window).alias("w"))
        .agg(total.alias("total_operations"), failed.alias("failed_operations"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "total_operations",
            "failed_operations",
            (F.col("failed_operations") / F.col("total_operations")).alias("error_rate"),
        )
    )


def run_available(
    stream: DataFrame, target: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode(mode)
        .start(target)
    )

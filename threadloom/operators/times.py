"""Date operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import dates, zones
from threadloom.operators.filters import after_date


def parse_times(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to timestamps; what cannot be read becomes null."""
    return df.withColumns({c: dates.to_time(F.col(c)) for c in columns})


def localize_to_utc(
    df: DataFrame, *columns: str, zone: str = "America/New_York", on_change: str = "raise"
) -> DataFrame:
    """Naive times of a zone to naive UTC.

    ``on_change`` says what becomes of times that clock changes repeat or leave
    out: ``raise``, ``null``, ``earlier`` or ``later``.
    """
    changes = zones.clock_changes(df.sparkSession, zone)
    return df.withColumns({c: zones.local_to_utc(F.col(c), zone, changes, on_change) for c in columns})


def clock_problems(df: DataFrame, column: str, zone: str = "America/New_York") -> DataFrame:
    """Add ``clock_problem``: ``ambiguous``, ``non-existent`` or null."""
    changes = zones.clock_changes(df.sparkSession, zone)
    return df.withColumn("clock_problem", zones.clock_problem(F.col(column), changes))


def shift_back(df: DataFrame, column: str, hours: int = 0) -> DataFrame:
    return df.withColumn(column, dates.shift(F.col(column), hours=-hours))


def add_days(df: DataFrame, column: str, days: int) -> DataFrame:
    return df.withColumn(column, dates.shift(dates.to_time(F.col(column)), days=days))


def subtract_days(df: DataFrame, column: str, days: int) -> DataFrame:
    return add_days(df, column, -days)


def format_dates(
    df: DataFrame,
    posted_col: str = "posted_date_time",
    collected_col: str = "collected_date_time",
    lag_hours: int = 2,
) -> DataFrame:
    """Parse both times, drop rows lacking one, move the collection time back
    and write it, with its hour, as text."""
    parsed = parse_times(df, posted_col, collected_col).dropna(subset=[posted_col, collected_col])
    collected = dates.shift(F.col(collected_col), hours=-lag_hours)
    return parsed.withColumns(
        {
            "collected_date_hour": dates.hour_key(collected),
            collected_col: dates.format_time(collected),
        }
    )


def hour_keys(df: DataFrame) -> DataFrame:
    """``date_hour`` from itself, or from ``Timestamp``, which is floored as well."""
    if "date_hour" in df.columns:
        hour = dates.to_time(F.col("date_hour"), dates.HOUR_FORMAT)
        return df.withColumn("date_hour", dates.hour_key(hour))
    if "Timestamp" in df.columns:
        floored = df.withColumn("Timestamp", dates.floor_hour(dates.to_time(F.col("Timestamp"))))
        return floored.withColumn("date_hour", dates.hour_key(F.col("Timestamp")))
    raise ValueError("no 'date_hour' or 'Timestamp' column")


def standardize_time(
    df: DataFrame, time_col: str | None, filter_date: str | None = None
) -> DataFrame:
    """Filter by date, then parse the time column with its ``+00:00`` cut off."""
    if not time_col:
        return df
    kept = after_date(df, time_col, filter_date)
    if not isinstance(kept.schema[time_col].dataType, T.StringType):
        return parse_times(kept, time_col)
    plain = dates.without_utc_suffix(F.col(time_col))
    return kept.withColumn(time_col, dates.to_time(plain))


def temporal_extent(df: DataFrame, time_col: str, *by: str) -> DataFrame:
    """First and last time, as text, of the table or of each group."""
    c = F.col(time_col)
    return df.groupBy(*by).agg(
        dates.format_time(F.min(c)).alias("start_date"),
        dates.format_time(F.max(c)).alias("end_date"),
    )

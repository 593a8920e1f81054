"""Row filters and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import dates
from threadloom.functions.strings import is_blank, min_length


def _is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))


def _instant(df: DataFrame, name: str, value: str | dt.date | dt.datetime) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    kind = df.schema[name].dataType if _is_time(df, name) else T.TimestampType()
    return F.lit(str(value)).cast(kind)


def _time_column(df: DataFrame, name: str, strict: bool) -> Column:
    c = F.col(name)
    if _is_time(df, name):
        return c
    return c.cast("timestamp") if strict else dates.to_time(c)


def after_date(
    df: DataFrame, time_col: str | None, date: str | dt.date | None, strict: bool = True
) -> DataFrame:
    """Rows dated later than ``date``; the day itself is excluded.

    Written as "not before the next midnight", which the scan can apply. With
    ``strict`` a time that cannot be read is an error, else its row drops.
    Without a date or a time column the input comes back as it is.
    """
    if date is None or time_col is None or time_col not in df.columns:
        return df
    day = dt.date.fromisoformat(str(date)[:10])
    midnight = f"{day + dt.timedelta(days=1)} 00:00:00"
    return df.filter(_time_column(df, time_col, strict) >= _instant(df, time_col, midnight))


def date_range(
    df: DataFrame, time_col: str, start: str | dt.datetime, end: str | dt.datetime
) -> DataFrame:
    """Rows within the range, both ends included; unreadable times drop.

    A column of text comes back parsed.
    """
    if not _is_time(df, time_col):
        df = df.withColumn(time_col, dates.to_time(F.col(time_col)))
    c = F.col(time_col)
    return df.filter(
        (c >= _instant(df, time_col, start)) & (c <= _instant(df, time_col, end))
    )


def drop_null_dates(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def long_enough(df: DataFrame, text_col: str, n: int = 20, trimmed: bool = False) -> DataFrame:
    return df.filter(min_length(F.col(text_col), n, trimmed))


def non_blank(df: DataFrame, text_col: str) -> DataFrame:
    return df.filter(~is_blank(F.col(text_col)))


def rename_positionally(df: DataFrame, *names: str) -> DataFrame:
    """Give the columns new names by position; their number must match."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)

"""Schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_POSTS = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("posted_date_time", T.StringType()),
        T.StructField("text_clean", T.StringType()),
        T.StructField("filename", T.StringType()),
    ]
)

KNOWLEDGE_BASE = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("posted_date_time", T.TimestampType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False)),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("posted_date_time", T.TimestampType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("step_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("comment", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("ts", T.TimestampType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("alert_name", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

"""Bounded training samples, the same on every run, and the rows that may teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; a null key is the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def sample_keys(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """At most ``size`` distinct keys, those of the smallest seeded hashes.

    Every task keeps its own smallest; only keys travel, never texts.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    keys = rows.select(F.col(key).alias("key"), order.alias("order")).where(F.col(key).isNotNull())
    return keys.distinct().orderBy("order").limit(size).select("key")


def sampled_texts(docs: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """``text`` of each of the bounded ``keys``, which may carry other columns.

    Of documents that share a key, the one of the least text digest; tasks pass
    on one each, so a key of very many documents brings one row.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    least = F.min(F.struct(F.sha2("text", 256).alias("digest"), F.col("text").alias("text")))
    met = own.join(F.broadcast(keys), "key").groupBy(*keys.columns).agg(least.alias("least"))
    return met.select(*keys.columns, F.col("least.text").alias("text"))

"""Sharding by extendible hashing: a directory of hash-prefix bits, split only where needed.

A bucket is a prefix of the key's hash. Starting from the empty prefix, a
bucket above the byte limit splits on its next bit, so a document's bucket is
its shortest prefix whose documents fit. All prefixes up to a depth are summed
from one histogram of cells; documents in cells that are still too large go one
level deeper, alone. The directory stays in Spark: one row per cell, joined to
the documents by equality.

Documents whose whole hashes agree cannot be told apart by more bits. If their
bucket is still too large, it becomes a chain of pages that each keep the
limit. A single document above the limit is a shard of its own, whatever its key.

Defined results: null text has no bytes, a null key hashes as the empty string;
repeated rows and keys are placed like any other, each above the limit in a
shard of its own; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tables import stored
from threadloom.sizing import broadcast_measured

LIMIT = 256 << 20
#: bits of the hash, and how many of them one level of the directory looks at
HASH_BITS = 48
LEVEL_BITS = 16


def key_hash(key: Column) -> Column:
    """The first 48 bits of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (HASH_BITS - depth).cast("int"))


def _bits(prefix: Column, depth: Column) -> Column:
    """The prefix written as ``depth`` binary digits."""
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, "0"))


def _directory(rows: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """``cell`` (prefix of ``depth`` bits) with the bucket it lies in; null where too large.

    Buckets are sought from ``above`` bits on; the prefixes there and before
    are known to be too large.
    """
    cells = rows.groupBy(_prefix(F.col("h"), F.lit(depth)).alias("cell")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs")
    )
    cells = stored(cells, "cells")
    levels = cells.select("cell", "n_bytes", "n_docs", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")))
    nodes = levels.groupBy("depth", "prefix").agg(
        F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs")
    )
    fitting = nodes.where(F.col("shard_bytes") <= limit)
    # the shortest fitting prefix of every cell
    found = levels.select("cell", "depth", "prefix").join(fitting, ["depth", "prefix"])
    bucket = F.struct("depth", "prefix", "shard_bytes", "shard_docs")
    best = found.groupBy("cell").agg(F.min(bucket).alias("bucket"))
    return stored(cells.select("cell").join(best, "cell", "left"), "directory")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of too large buckets of one hash, dealt to pages that keep the limit.

    Places in the chain are sums within a task, then over tasks, so a key with
    most of the rows is not gathered anywhere.
    """
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows, "overflow")
    within = Window.partitionBy("h", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("n_bytes").over(within), F.lit(0)))
    sums = rows.groupBy("h", "part").agg(F.sum("n_bytes").alias("sum"))
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("h", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    most = rows.groupBy("h").agg(F.max("n_bytes").alias("most"))
    placed = rows.join(base, ["h", "part"]).join(most, "h")
    # a page begins anew after so many bytes that one more document cannot pass the limit
    width = F.greatest(F.lit(limit) - F.col("most"), F.lit(1))
    page = F.floor((F.col("base") + F.col("begin")) / width)
    return placed.withColumn("page", page.cast("bigint"))


def _alone(rows: DataFrame) -> DataFrame:
    """Documents above the limit, numbered from 0 among those of one key, to tell their shards apart.

    A number is a count within a task on top of those of the tasks before.
    """
    digest = F.sha2(F.coalesce(F.col("key").cast("string"), F.lit("")), 256)
    rows = rows.withColumns({"digest": digest, "part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    rows = stored(rows, "alone")
    within = F.row_number().over(Window.partitionBy("digest", "part").orderBy("at")) - 1
    counts = rows.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("digest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.withColumn("within", within).join(base, ["digest", "part"]).withColumn("number", F.col("base") + F.col("within"))


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``n_bytes``, ``shard``, ``depth``, ``shard_bytes``, ``shard_docs``.

    ``shard`` is the bucket's bits, with ``-page`` for a chain and ``-alone``,
    the key's digest and, among documents of one key, a number for a document
    above the limit.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(key).alias("key"), size.alias("n_bytes"), key_hash(F.col(key)).alias("h"))
    rows = stored(rows, "sizes")
    columns = ["key", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    number = F.when(F.col("number") > 0, F.concat(F.lit("-"), "number")).otherwise("")
    alone = _alone(rows.where(F.col("n_bytes") > limit)).select(
        "key",
        "n_bytes",
        F.concat(_bits(F.col("h"), F.lit(HASH_BITS)), F.lit("-alone-"), "digest", number).alias("shard"),
        F.lit(HASH_BITS).alias("depth"),
        F.col("n_bytes").alias("shard_bytes"),
        F.lit(1).cast("bigint").alias("shard_docs"),
    )
    result = alone
    left = rows.where(F.col("n_bytes") <= limit)
    for above in range(0, HASH_BITS, LEVEL_BITS):
        depth = above + LEVEL_BITS
        directory = _directory(left, above, depth, limit)
        cell = _prefix(F.col("h"), F.lit(depth))
        joined = left.withColumn("cell", cell).join(broadcast_measured(directory), "cell")
        b = F.col("bucket")
        settled = joined.where(b.isNotNull()).select(
            "key",
            "n_bytes",
            _bits(b["prefix"], b["depth"]).alias("shard"),
            b["depth"].alias("depth"),
            b["shard_bytes"].alias("shard_bytes"),
            b["shard_docs"].alias("shard_docs"),
        )
        result = result.unionByName(settled)
        if directory.where("bucket IS NULL").isEmpty():
            return result.select(F.col("key").alias(key), *columns[1:])
        left = stored(joined.where(b.isNull()).select("key", "n_bytes", "h"), "deeper")
    paged = _pages(left, limit)
    totals = paged.groupBy("h", "page").agg(
        F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs")
    )
    chained = paged.join(totals, ["h", "page"]).select(
        "key",
        "n_bytes",
        F.concat(_bits(F.col("h"), F.lit(HASH_BITS)), F.lit("-"), F.col("page")).alias("shard"),
        F.lit(HASH_BITS).alias("depth"),
        "shard_bytes",
        "shard_docs",
    )
    return result.unionByName(chained).select(F.col("key").alias(key), *columns[1:])

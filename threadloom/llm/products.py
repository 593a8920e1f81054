"""Exact largest inner products by buckets of like length.

Vectors of whole numbers are sorted by length and stored. A batch of them is cut
into buckets whose lengths differ by a tenth at most. A query with a score
``floor`` to beat needs, in a bucket with the longest length ``l``, a cosine of
at least ``floor / (|q| * l)``: above one the bucket is passed over. Up to
``COORDINATES_FROM`` the bucket is cut by length: only its vectors of length
``floor / |q|`` or more can reach the floor. Beyond, each of a query's largest
coordinates bounds the same coordinate of any vector within that angle; where
the shortest of these sorted intervals is short enough, only vectors inside all
of them are looked at. What is left is verified by its exact product.

The floors begin with the products of each query with a few thousand of the
longest vectors and rise as a task goes on. A floor only ever leaves out what
cannot be among the best, so results are exact. Queries go out in passes of a
bounded number; a pass reads only vectors long enough for one of its floors.

Defined results: vectors that are null or hold null or non-finite entries take
no part, shorter ones end in zeros. Rows are told apart, not keys: rows that
repeat a key are queries and candidates of their own, and a query leaves out
only its own row. Ties go to the smaller key, a null key last; a null key is
never asked for. Zero vectors score 0. A table without other rows gives none. A
product that may not fit 64 bits is an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.tables import scratch, stored
from threadloom.llm.vectors import matrix, whole, width_of

#: lengths of a bucket are at least this share of its longest
RATIO = 0.9
BUCKET = 2048
#: local cosine threshold from which coordinates are tried
COORDINATES_FROM = 0.7
#: coordinates of a query that bound its candidates
FOCUS = 4
#: vectors a dense product takes in the time of one picked by coordinates
PICK = 8
#: longest vectors that give the first floors
SEEDS = 4096
#: numbers in the queries of one pass, 32 MB
PASS_NUMBERS = 4_000_000
#: queries multiplied with a bucket at a time
TOGETHER = 512
#: found rows that wait until they are merged into the best
WAITING = 250_000
#: first merge step: tasks whose results meet
MERGE_TASKS = 256
#: bounds from floating-point lengths are widened by this
SLACK = 1e-9
NONE = np.iinfo("int64").min


@dataclass
class Asked:
    """Queries of one pass, in the order of the length that they need."""

    uid: np.ndarray
    x: np.ndarray
    length: np.ndarray
    floor: np.ndarray

    def needs(self) -> np.ndarray:
        """The least length of a vector that can reach the floor; 0 where any can."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.maximum(self.floor, 0) / self.length
        return np.where(self.floor > 0, need * (1 - SLACK), 0.0)


def products(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """All inner products of rows, exact; ``limit`` bounds them by the lengths."""
    if limit < 1 << 53:
        return (a.astype("float64") @ b.astype("float64").T).astype("int64")
    if limit < 1 << 62:
        return a @ b.T
    raise ArithmeticError("an inner product may not fit 64 bits")


def _limit(a: np.ndarray, b: np.ndarray) -> float:
    return float(a.max(initial=0.0)) * float(b.max(initial=0.0)) * (1 + SLACK)


def buckets(length: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of falling lengths: few rows, and lengths of at least ``RATIO`` of the first."""
    cuts, start = [], 0
    while start < len(length):
        like = np.searchsorted(-length, -RATIO * length[start], side="right")
        end = min(int(like), start + BUCKET)
        cuts.append((start, end))
        start = end
    return cuts


def _intervals(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a unit vector's coordinate from a query's, both within an angle."""
    turn = np.arccos(np.clip(cosine, -1.0, 1.0))
    own = np.arccos(np.clip(q, -1.0, 1.0))
    low = np.where(own + turn >= np.pi, -1.0, np.cos(np.minimum(own + turn, np.pi)))
    high = np.where(own <= turn, 1.0, np.cos(np.maximum(own - turn, 0.0)))
    return low - SLACK, high + SLACK


def pick(unit: np.ndarray, ask: np.ndarray, cosine: np.ndarray) -> list[np.ndarray | None]:
    """Rows of ``unit`` that the focus coordinates leave to each query; None: too many to pick."""
    sorted_, order = np.sort(unit, axis=0), np.argsort(unit, axis=0)
    n_focus = min(FOCUS, unit.shape[1])
    focus = np.argsort(-np.abs(ask), axis=1, kind="stable")[:, :n_focus]
    low, high = _intervals(np.take_along_axis(ask, focus, axis=1), cosine[:, None])
    first, last = np.zeros(focus.shape, dtype="int64"), np.zeros(focus.shape, dtype="int64")
    for f in np.unique(focus):
        here = focus == f
        first[here] = np.searchsorted(sorted_[:, f], low[here], side="left")
        last[here] = np.searchsorted(sorted_[:, f], high[here], side="right")
    shortest = np.argmin(last - first, axis=1)
    picked: list[np.ndarray | None] = []
    for i, s in enumerate(shortest):
        a, b = first[i, s], last[i, s]
        if PICK * (b - a) > len(unit):
            picked.append(None)
            continue
        rows = order[a:b, focus[i, s]]
        held = unit[rows][:, focus[i]]
        picked.append(rows[((held >= low[i]) & (held <= high[i])).all(axis=1)])
    return picked


def look(asked: Asked, uid: np.ndarray, x: np.ndarray, length: np.ndarray) -> Iterator[tuple]:
    """(query places, rows, scores) of one bucket, falling lengths, that reach the floors."""
    needs = asked.needs()
    # queries stand in the order of their needs, which rise alike as floors do only roughly
    live = np.flatnonzero(needs <= length[0])
    for at in range(0, len(live), TOGETHER):
        own = live[at : at + TOGETHER]
        limit = _limit(asked.length[own], length)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = asked.floor[own] / (asked.length[own] * length[0])
        cosine = np.where(asked.floor[own] > 0, cosine * (1 - SLACK), -1.0)
        dense = np.ones(len(own), dtype=bool)
        sharp = np.flatnonzero(cosine >= COORDINATES_FROM)
        if len(sharp):
            unit = x / np.maximum(length, 1e-300)[:, None]
            ask = asked.x[own[sharp]] / asked.length[own[sharp]][:, None]
            for s, rows in zip(sharp, pick(unit, ask, cosine[sharp])):
                if rows is None:
                    continue
                dense[s] = False
                scores = products(asked.x[own[s]][None], x[rows], limit)[0]
                good = (scores >= asked.floor[own[s]]) & (uid[rows] != asked.uid[own[s]])
                yield np.full(int(good.sum()), own[s]), rows[good], scores[good]
        rest = own[dense]
        if not len(rest):
            continue
        # lengths fall: the part of the bucket that is long enough for one of these
        end = int(np.searchsorted(-length, -needs[rest].min(), side="right"))
        scores = products(asked.x[rest], x[:end], limit)
        query, row = np.nonzero(scores >= asked.floor[rest][:, None])
        other = asked.uid[rest][query] != uid[row]
        query, row = query[other], row[other]
        yield rest[query], row, scores[query, row]


def _best(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` greatest scores of each query, ties by smaller key, a null key last."""
    keys = [("query", "ascending"), ("score", "descending"), ("key", "ascending")]
    found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_end"))
    query = found["query"].to_numpy()
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else []
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return found.filter(pa.array(place < k))


def _searched(asked: Asked, k: int, width: int):
    """Task function: the best rows of one partition for every query of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Asked(asked.uid, asked.x, asked.length, asked.floor.copy())
        best: pa.Table | None = None
        waiting: list[pa.Table] = []

        def merge() -> None:
            nonlocal best
            best = _best(pa.concat_tables([*([best] if best else []), *waiting]), k)
            waiting.clear()
            query = best["query"].to_numpy()
            counts = np.bincount(query, minlength=len(mine.uid))
            full = counts >= k
            mine.floor[full] = best["score"].to_numpy()[(np.cumsum(counts) - 1)[full]]

        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(-length, kind="stable")
            rows = batch.take(pa.array(order))
            length, x = length[order], matrix(rows.column(2), width)
            uid = rows.column(0).to_numpy(zero_copy_only=False)
            for a, b in buckets(length):
                for query, row, scores in look(mine, uid[a:b], x[a:b], length[a:b]):
                    if len(query):
                        waiting.append(
                            pa.table(
                                {
                                    "query": pa.array(query, pa.int64()),
                                    "score": pa.array(scores, pa.int64()),
                                    "key": rows.column(1).take(pa.array(row + a)),
                                }
                            )
                        )
                if sum(map(len, waiting)) > WAITING:
                    merge()
        if waiting:
            merge()
        if best:
            uids = pa.array(mine.uid).take(best["query"].combine_chunks())
            yield from best.set_column(0, "uid", uids).combine_chunks().to_batches()

    return run


def _seeded(seeds: Asked, k: int, width: int):
    """Task function: the floor of each query, its ``k``-th best score among the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            floor = np.full(n, NONE)
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            length = batch.column(3).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(2), width)
            for a in range(0, n if len(seeds.uid) >= k else 0, TOGETHER):
                b = a + TOGETHER
                scores = products(x[a:b], seeds.x, _limit(length[a:b], seeds.length))
                scores[uid[a:b, None] == seeds.uid] = NONE
                floor[a:b] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    return run


def by_length(df: DataFrame, key: str, vec: str, scale: float) -> DataFrame:
    """``uid, id, x, length`` of every vector, stored in the order of falling length.

    A salt behind the length parts vectors of one length, however many there are.
    """
    squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    rows = whole(df, key, vec, scale).withColumn("length", F.sqrt(squares))
    rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.desc("length"), "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "x", "length"), "lengths")


def _gathered(rows: DataFrame, width: int) -> Asked:
    """A bounded frame on the driver; without a column of floors they are open."""
    t = rows.toArrow()
    floor = t["floor"].to_numpy() if "floor" in t.column_names else np.full(len(t), NONE)
    x = matrix(t["x"].combine_chunks(), width) if len(t) else np.zeros((0, width), dtype="int64")
    return Asked(t["uid"].to_numpy(), x, t["length"].to_numpy(), floor)


def longest(index: DataFrame, n: int) -> DataFrame:
    """About ``n`` of the longest vectors, all of them if there are fewer."""
    grade = F.floor(8 * F.log2(F.greatest(F.col("length"), F.lit(1e-3))))
    counts = index.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    left = n
    for row in sorted(counts.collect(), key=lambda r: -r["g"]):
        if row["n"] >= left:
            # of like lengths any will do: they are drawn, for one length may be all there is
            drawn = F.rand(17) < left / row["n"]
            return index.where((grade > row["g"]) | (grade == row["g"]) & drawn)
        left -= row["n"]
    return index


def top_products(
    df: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", scale: float = 64.0
) -> DataFrame:
    """``query_id, rank, <key>, score``: the ``k`` greatest products of each row where ``asked`` holds.

    ``asked`` is an expression over the column ``id``, the key.
    """
    spark = df.sparkSession
    index = by_length(df, key, vec, scale)
    width = width_of(index)
    seeds = _gathered(longest(index, SEEDS), width)
    schema = T.StructType([*index.schema.fields, T.StructField("floor", T.LongType())])
    queries = stored(index.where(asked).mapInArrow(_seeded(seeds, k, width), schema), "asked")
    n = queries.count()
    passes = max(1, -(-n * max(width, 1) // PASS_NUMBERS))
    dealt = F.pmod(F.xxhash64("uid"), F.lit(passes))
    id_type = index.schema["id"].dataType
    kept = T.StructType(
        [T.StructField("uid", T.LongType()), T.StructField("score", T.LongType()), T.StructField("key", id_type)]
    )
    path = scratch(spark, "found")
    for i in range(passes):
        block = _gathered(queries.where(dealt == i), width)
        if not len(block.uid):
            continue
        needs = block.needs()
        order = np.argsort(needs, kind="stable")
        block = Asked(block.uid[order], block.x[order], block.length[order], block.floor[order])
        long_enough = index.where(F.col("length") >= float(needs.min()))
        found = long_enough.mapInArrow(_searched(block, k, width), kept)
        found.withColumn("task", F.spark_partition_id()).write.mode("append").parquet(path)
    schema = kept.add("task", T.IntegerType())
    found = spark.read.schema(schema).parquet(path) if n else spark.createDataFrame([], schema)
    best = [F.desc("score"), F.asc_nulls_last("key")]
    groups = W.partitionBy("uid", "group").orderBy(*best)
    ranked = (
        found.withColumn("group", F.floor(F.col("task") / MERGE_TASKS))
        .withColumn("rank", F.row_number().over(groups))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(W.partitionBy("uid").orderBy(*best)))
        .where(F.col("rank") <= k)
    )
    named = ranked.join(queries.select("uid", F.col("id").alias("query_id")), "uid")
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")

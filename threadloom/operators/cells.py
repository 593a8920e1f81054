"""Exact retrieval from an index of cells: only cells that may hold a result are read.

The vectors' directions are grouped around centres by k-means, fitted on a
bounded sample; every vector is put into the cell of its nearest centre. By the
triangle inequality of angles, a vector whose angle from the centre lies between
the cell's least and greatest cannot be nearer to a query than the query's own
angle from the centre lies off that ring. Cells are read in the order of these
bounds, a few more in each wave, until the similarity of the k-th thread is
above the bound of every cell not read: then the k threads are proven to be the
best, with the very rows that a pass over all vectors would give.

Vectors without a direction are a cell of their own, read only for queries that
find fewer than k threads. A cell may hold any share of the rows; it is stored
in as many parts as its size asks for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.similarity import (
    BLOCK_BEST,
    BLOCK_NUMBERS,
    CELLS,
    DIGITS,
    NO_SIMILARITY,
    Best,
    _blocks,
    _found,
    _matrix,
    _merged,
    _unit,
)
from threadloom.session import scratch_path

#: the centres are fitted on about so many numbers, and vectors for each centre
SAMPLE_NUMBERS = 8_000_000
SAMPLE_PER_CELL = 64
MOST_CELLS = 4096
ROUNDS = 8
#: cells that a query's first wave reads; each later wave reads so many times more
FIRST_WAVE, WAVE_GROWTH = 4, 3
#: bounds of a block of queries, 64 MB of doubles
BLOCK_BOUNDS = 8_000_000
#: the cell of vectors without a direction; its bound is NO_SIMILARITY
NOWHERE = -1
#: angles are widened by this: similarities are rounded
SLACK = 1e-7


@dataclass
class Index:
    """Cells of a table: where its rows are, unit centres, and each cell's ring and size."""

    path: str
    key: str
    thread_col: str
    centres: np.ndarray
    cells: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray

    @property
    def total(self) -> int:
        return int(self.rows.sum())

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The greatest similarity that each cell may hold for each query."""
        away = np.arccos(np.clip(unit @ self.centres.T, -1.0, 1.0))[:, np.maximum(self.cells, 0)]
        off = np.maximum(np.maximum(away - self.most, self.least - away) - SLACK, 0.0)
        return np.where(self.cells == NOWHERE, NO_SIMILARITY, np.cos(off) + SLACK)


@dataclass
class Effort:
    """What a search did: comparisons, out of those of a pass over all rows, and waves."""

    queries: int = 0
    compared: int = 0
    of: int = 0
    waves: int = 0


def _centres(sample: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Unit centres of ``n`` groups of unit vectors: spherical k-means."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:n]]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _placed(centres: np.ndarray):
    """The cell of each vector and its angle from the centre."""
    step = max(1, CELLS // len(centres))

    @F.arrow_udf("cell int, angle double")
    def place(column: pa.Array) -> pa.Array:
        cell, angle = np.full(len(column), NOWHERE, dtype="int32"), np.zeros(len(column))
        for at in range(0, len(column), step):
            with np.errstate(invalid="ignore"):
                unit = _unit(_matrix(column.slice(at, step), centres.shape[1]))
            some = np.flatnonzero(~np.isnan(unit[:, 0]))
            near = unit[some] @ centres.T
            own = np.argmax(near, axis=1)
            cell[at + some] = own
            angle[at + some] = np.arccos(np.clip(near[np.arange(len(some)), own], -1.0, 1.0))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], names=["cell", "angle"])

    return place


def build_index(
    df: DataFrame,
    path: str,
    key: str = "id",
    thread_col: str = "thread_id",
    embedding_col: str = "embedding",
    n_cells: int | None = None,
    seed: int = 17,
) -> Index:
    """Write the cells of a table to a folder; the sample that fits the centres is all that meets.

    Vectors of the most common width count; others have no direction.
    """
    spark = df.sparkSession
    own = df.select(F.col(key).alias("key"), F.col(thread_col).alias("thread"), F.col(embedding_col).alias("vector"))
    widths = own.where("size(vector) > 0").groupBy(F.size("vector").alias("w")).count().collect()
    if not widths:
        raise ValueError("no vector to build cells of")
    width = max(widths, key=lambda r: (r["count"], r["w"]))["w"]
    n = sum(r["count"] for r in widths)
    n_cells = n_cells or max(1, min(MOST_CELLS, round(n**0.5), SAMPLE_NUMBERS // (SAMPLE_PER_CELL * width) or 1))
    wanted = SAMPLE_PER_CELL * n_cells
    drawn = own.where(F.size("vector") == width)
    if n > wanted:
        drawn = drawn.where(F.rand(seed) < wanted / n)
    vectors = drawn.select("vector").toArrow()["vector"].combine_chunks()
    with np.errstate(invalid="ignore"):
        unit = _unit(_matrix(vectors, width))
    unit = unit[~np.isnan(unit[:, 0])]
    # none drawn: any direction will do, the rings are measured on all rows
    centres = _centres(unit, n_cells, seed) if len(unit) else np.eye(1, width)
    placed = own.withColumn("at", _placed(centres)("vector")).select("key", "thread", "vector", "at.cell", "at.angle")
    # a salt parts a cell that holds a large share of the rows
    salt = F.xxhash64(F.monotonically_increasing_id())
    dealt = placed.withColumn("_salt", salt).repartitionByRange("cell", "_salt").sortWithinPartitions("cell", "angle")
    dealt.drop("_salt").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    rings = _rows(spark, path, own.schema).groupBy("cell")
    rings = rings.agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count(F.lit(1)).alias("rows"))
    named = F.lit(json.dumps({"key": key, "thread_col": thread_col}))
    centre = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    rings.join(centre, "cell", "full").withColumn("names", named).write.mode("overwrite").parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    found = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
    centres = np.array([r.centre for r in found if r.centre is not None])
    filled = [r for r in found if r.rows]
    names = json.loads(found[0].names)
    column = lambda name, kind: np.array([r[name] for r in filled], dtype=kind)
    return Index(
        path, names["key"], names["thread_col"], centres,
        column("cell", "int64"), column("least", float), column("most", float), column("rows", "int64"),
    )


def _rows(spark: SparkSession, path: str, own: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if own is not None:
        reader = reader.schema(T.StructType([*own.fields, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())]))
    return reader.parquet(f"{path}/rows")


def _cells_best(ids: pa.Array, unit: np.ndarray, floors: np.ndarray, asked: dict[int, np.ndarray], n: int):
    """Task function: the best row of each of a query's best threads, in the cells it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(unit, n, True, floors)
        for batch in batches:
            cells = batch.column(3).to_numpy()
            for cell in np.unique(cells):
                queries = asked.get(int(cell))
                if queries is not None:
                    best.add(batch.take(pa.array(np.flatnonzero(cells == cell))), queries)
        yield from best.batches(ids)

    return run


def _wave(bounds: np.ndarray, read: np.ndarray, floors: np.ndarray, size: int) -> np.ndarray:
    """The next cells of each query: the best ``size`` not read whose bound reaches its floor."""
    open_ = np.where(~read & (bounds >= floors[:, None]), bounds, -np.inf)
    if size < open_.shape[1]:
        least = -np.partition(-open_, size - 1, axis=1)[:, size - 1 : size]
        return (open_ >= least) & (open_ > -np.inf)
    return open_ > -np.inf


def _search_block(
    spark: SparkSession, index: Index, ids: pa.Array, id_type: T.DataType, queries: np.ndarray, k: int, effort: Effort
) -> DataFrame:
    """(query_id, key, thread, similarity, rank) of one block of queries, stored."""
    if queries.shape[1] != index.centres.shape[1]:
        raise ValueError(f"queries of {queries.shape[1]} numbers, an index of {index.centres.shape[1]}")
    table = _rows(spark, index.path)
    schema = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("key", table.schema["key"].dataType),
            T.StructField("thread", table.schema["thread"].dataType),
            T.StructField("rank_by", T.DoubleType()),
        ]
    )
    with np.errstate(invalid="ignore"):
        unit = _unit(queries)
    # a query without a direction is at no angle from anything: it reads all cells
    bounds = np.where(np.isnan(unit[:, :1]), np.inf, index.bounds(np.nan_to_num(unit)))
    read, floors = np.zeros(bounds.shape, dtype=bool), np.full(len(queries), -np.inf)
    place = {q: i for i, q in enumerate(ids.to_pylist())}
    best, size = None, FIRST_WAVE
    while (now := _wave(bounds, read, floors, size)).any():
        asked = {int(c): np.flatnonzero(now[:, i]) for i, c in enumerate(index.cells) if now[:, i].any()}
        # the folders of these cells are all that is listed and read
        rows = table.where(F.col("cell").isin(*asked)).select("key", "thread", "vector", "cell")
        parts = rows.mapInArrow(_cells_best(ids, unit, floors, asked, k), schema)
        parts = parts.withColumn("_task", F.spark_partition_id())
        if best is not None:
            before = best.select("query_id", "key", "thread", F.coalesce("similarity", F.lit(NO_SIMILARITY)).alias("rank_by"))
            parts = parts.unionByName(before.withColumn("_task", F.lit(-1)))
        stored = scratch_path(spark, "wave")
        merged = _merged(parts, k, True)
        merged.write.parquet(stored)
        best = spark.read.schema(merged.schema).parquet(stored)
        for row in best.where(F.col("rank") == k).select("query_id", "similarity").collect():
            floors[place[row.query_id]] = NO_SIMILARITY if row.similarity is None else row.similarity
        read |= now
        effort.compared += int((now * index.rows).sum())
        effort.waves += 1
        size *= WAVE_GROWTH
    effort.queries += len(queries)
    effort.of += len(queries) * index.total
    return best


def top_threads_in_cells(
    df: DataFrame,
    index: Index,
    queries: DataFrame,
    k: int = 100,
    columns: Sequence[str] = ("text", "thread_id", "posted_date_time"),
    query_id: str = "query_id",
    query_col: str = "embedding",
) -> tuple[DataFrame, Effort]:
    """``similarity.top_threads`` from an index of ``df``: the same rows, and what it took.

    Query ids name the queries, so they must be unique and not null.
    """
    spark, effort = df.sparkSession, Effort()
    id_type = queries.schema[query_id].dataType
    found: list[DataFrame] = []
    most = max(1, min(BLOCK_BOUNDS // len(index.cells), BLOCK_BEST // k, BLOCK_NUMBERS // index.centres.shape[1]))
    for ids, matrix in _blocks(queries, query_id, query_col, k, most):
        found.append(_search_block(spark, index, ids, id_type, matrix, k, effort))
    if not found:
        raise ValueError("no query has a vector")
    stored = scratch_path(spark, "cells-found")
    for block in found:
        block.write.mode("append").parquet(stored)
    chosen = spark.read.schema(found[0].schema).parquet(stored)
    return _found(df, chosen, index.key, index.thread_col, columns, k * effort.queries), effort

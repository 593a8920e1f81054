"""Nearest rows against brute force, with ties, zero vectors and copies."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.operators import similarity


def table(spark, seed=0, rows=400):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(rows, 6))
    vectors[rows // 3 :: 3] = vectors[1]
    vectors[5] = 0
    data = [(i, f"t{i % 40}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return vectors, spark.createDataFrame(data, "id int, thread string, embedding array<float>")


def ranked(vectors, query):
    v = vectors.astype("float32").astype("float64")
    with np.errstate(invalid="ignore"):
        sims = np.round((v @ query) / np.linalg.norm(v, axis=1) / np.linalg.norm(query), 9)
    return sorted(range(len(v)), key=lambda i: (-2 if np.isnan(sims[i]) else sims[i], -i), reverse=True)


def test_top_with_ties(spark):
    vectors, df = table(spark)
    query = vectors[1]
    got = similarity.top_similar(df.repartition(7), query, 150, "id", ["thread"]).orderBy("rank")
    assert [r.id for r in got.collect()] == ranked(vectors, query)[:150]


def test_zero_vector_is_last(spark):
    vectors, df = table(spark)
    got = similarity.top_similar(df, vectors[0], 400, "id", ["thread"]).orderBy("rank").collect()
    assert got[-1].id == 5 and got[-1].similarity is None


def best_threads(vectors, query, k, thread):
    seen, want = set(), []
    for i in ranked(vectors, query):
        if thread(i) not in seen and len(want) < k:
            seen.add(thread(i))
            want.append(i)
    return want


def test_threads(spark):
    vectors, df = table(spark)
    query = vectors[1]
    for k in (1, 5, 20, 60):
        want = best_threads(vectors, query, k, lambda i: i % 40)
        assert len(want) == min(k, 40)
        got = similarity.top_threads(df, query, k, "id", "thread", ["thread"]).orderBy("rank")
        assert [r.id for r in got.collect()] == want


def test_hot_thread(spark):
    """One thread holds all the nearest rows: k threads are found all the same."""
    vectors, df = table(spark)
    query = vectors[1]
    order = ranked(vectors, query)
    hot = set(order[:300])
    df = df.withColumn("thread", F.when(F.col("id").isin(*hot), "hot").otherwise(F.col("thread")))
    want = best_threads(vectors, query, 20, lambda i: "hot" if i in hot else i % 40)
    for parts in (1, 9):
        got = similarity.top_threads(df.repartition(parts), query, 20, "id", "thread", ["thread"])
        assert [r.id for r in got.orderBy("rank").collect()] == want


def test_query_blocks(spark, monkeypatch):
    vectors, df = table(spark)
    queries = df.filter("id < 9 and id <> 5").select(F.col("id").alias("query_id"), "embedding")
    whole = similarity.top_threads(df, queries, 3, "id", "thread", ["thread"]).collect()
    monkeypatch.setattr(similarity, "BLOCK_NUMBERS", 12)
    monkeypatch.setattr(similarity, "CELLS", 20)
    monkeypatch.setattr(similarity, "MERGE_TASKS", 1)
    parts = similarity.top_threads(df, queries, 3, "id", "thread", ["thread"]).collect()
    key = lambda r: (r.query_id, r["rank"])
    assert sorted(whole, key=key) == sorted(parts, key=key)


def test_memory_is_bounded_by_tiles():
    """Many queries and a large batch: neither their product nor a batch's copies are held."""
    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(10_000, 16)), rng.normal(size=(1_500, 16))
    flat = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, 16, dtype="int32"), vectors.ravel())
    ids = pa.array(np.arange(len(vectors)))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(vectors)) % 40), flat], names=["k", "t", "v"])
    run = similarity._part_best(pa.array(np.arange(len(asked))), asked, 5, True)
    tracemalloc.start()
    base = pa.total_allocated_bytes()
    most = 0
    first_n = similarity._first_n

    def watched(found, *rest):
        nonlocal most
        most = max(most, pa.total_allocated_bytes() - base)
        return first_n(found, *rest)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(similarity, "_first_n", watched)
        found = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    numpy_most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most + numpy_most < 60e6
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(asked) @ unit(vectors).T, 9)
    for q in (0, 499, 500, 501, 1_499):
        threads = sims[q].reshape(-1, 40)
        want = sorted(threads.max(axis=0), reverse=True)[:5]
        assert [r["rank_by"] for r in found if r["query_id"] == q] == pytest.approx(want, abs=2e-9)
    assert len(found) == 5 * len(asked)

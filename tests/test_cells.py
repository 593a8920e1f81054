"""Retrieval from cells gives the rows of a pass over all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import cells, similarity


def clustered(spark, seed=0, rows=900, width=6):
    """Vectors in groups, copies, a hot thread, zero vectors, nulls and one of another width."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    v = centres[rng.integers(0, 12, rows)] + rng.normal(size=(rows, width)) * 0.1
    v[rows // 2 :: 4] = v[1]
    v[5] = v[6] = 0
    data = [(i, "hot" if i % 3 == 0 else f"t{i % 50}", [float(x) for x in r]) for i, r in enumerate(v)]
    data += [(rows, "n1", None), (rows + 1, "n2", [1.0]), (rows + 2, None, [float(x) for x in v[3]])]
    return spark.createDataFrame(data, "id int, thread string, embedding array<float>")


def key(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(r.asDict())) for r in df.collect())))


@pytest.mark.parametrize("k", [1, 5, 60])
@pytest.mark.parametrize("n_cells", [None, 1, 40])
def test_cells_give_what_a_full_pass_gives(spark, tmp_path, monkeypatch, k, n_cells):
    df = clustered(spark)
    index = cells.build_index(df, str(tmp_path / "i"), "id", "thread", n_cells=n_cells)
    assert index.total == df.count() and len(index.centres) == (n_cells or 30)
    queries = df.where("id < 900 and (id % 90 = 1 or id in (5, 700))").select(F.col("id").alias("query_id"), "embedding")
    if k == 5:
        monkeypatch.setattr(cells, "BLOCK_BOUNDS", 4 * len(index.cells))
    want = similarity.top_threads(df, queries, k, "id", "thread", ["thread"])
    got, effort = cells.top_threads_in_cells(df, index, queries, k, ["thread"])
    assert key(got) == key(want)
    assert effort.queries == queries.count() and effort.of == effort.queries * index.total
    assert effort.compared <= effort.of
    if k == 1 and n_cells != 1:
        # one query has no direction and reads everything
        assert effort.compared < effort.of / 2


def test_an_index_is_opened_again(spark, tmp_path):
    df = clustered(spark, 3, 200)
    built = cells.build_index(df, str(tmp_path / "i"), "id", "thread")
    found = cells.open_index(spark, str(tmp_path / "i"))
    assert (found.centres == built.centres).all() and found.key == "id" and found.total == 203
    queries = df.where("id = 7").select(F.col("id").alias("query_id"), "embedding")
    assert key(cells.top_threads_in_cells(df, found, queries, 3, ["thread"])[0]) == key(
        similarity.top_threads(df, queries, 3, "id", "thread", ["thread"])
    )
    with pytest.raises(ValueError, match="an index of 6"):
        cells.top_threads_in_cells(df, found, spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>"), 3)
    with pytest.raises(ValueError, match="no vector"):
        cells.build_index(df.where("embedding IS NULL"), str(tmp_path / "none"), "id", "thread")


def test_bounds_hold_for_every_vector(spark, tmp_path):
    df = clustered(spark, 4)
    index = cells.build_index(df, str(tmp_path / "i"), "id", "thread")
    rows = spark.read.parquet(str(tmp_path / "i/rows")).where("cell >= 0").toPandas()
    unit = np.array(rows["vector"].tolist(), dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    query = np.random.default_rng(9).normal(size=(20, 6))
    query /= np.linalg.norm(query, axis=1, keepdims=True)
    bounds = index.bounds(query)
    at = {c: i for i, c in enumerate(index.cells)}
    held = np.stack([bounds[:, at[c]] for c in rows["cell"]], axis=1)
    assert (query @ unit.T <= held + 1e-12).all() and (held.min(axis=1) < 0.5).all()

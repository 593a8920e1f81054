"""Exact retrieval and whitening against brute force over all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import products, whitening
from threadloom.llm.spectra import Spectrum, rank_one
from threadloom.llm.vector_queries import op13_whitening

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label string, x string, uid string, length string, floor string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 5) for i, v in rows], SCHEMA)


def fit_for(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whole(v, width):
    v = [math.floor(64 * float(np.float32(c))) for c in v]
    return v + [0] * (width - len(v))


def top_by_hand(rows, k, every):
    width = max((len(v) for _, v in rows if fit_for(v)), default=0)
    given = [(i, whole(v, width)) for i, v in rows if fit_for(v)]
    out = []
    for at, (q, x) in enumerate(given):
        if q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0, i) for n, (i, y) in enumerate(given) if n != at]
        scored.sort(key=lambda s: s[:3])
        out += [(q, rank, s[3], -s[0]) for rank, s in enumerate(scored[:k], 1)]
    return sorted(map(str, out))


def top(spark, rows, k=5, every=4):
    got = products.top_products(table(spark, rows), F.col("id") % every == 0, k).collect()
    return sorted(str(tuple(r)) for r in got)


def mixed(seed, n, width, spread):
    """Vectors in a few directions, lengths over ``spread`` powers of e, and copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * 0.15
    v *= np.exp(rng.normal(size=(n, 1)) * spread)
    v[: n // 3] = v[0]
    return [(int(i), r.tolist()) for i, r in zip(rng.permutation(n), v.astype("float32"))]


@pytest.mark.parametrize("spread,width", [(0.0, 8), (1.5, 8), (0.3, 3)])
def test_top_products_of_all_lengths(spark, monkeypatch, spread, width):
    monkeypatch.setattr(products, "SEEDS", 20)
    monkeypatch.setattr(products, "BUCKET", 64)
    monkeypatch.setattr(products, "PASS_NUMBERS", 40 * width)
    monkeypatch.setattr(products, "WAITING", 100)
    rows = mixed(3, 600, width, spread)
    assert top(spark, rows) == top_by_hand(rows, 5, 4)


def test_top_products_of_odd_rows(spark):
    rows = [(0, None), (4, [1.0, None]), (8, [float("nan"), 1.0]), (12, [float("inf"), 0.0]), (16, []), (20, [0.0, 0.0])]
    rows += [(24, [1.0, 2.0, 3.0]), (24, [1.0, 2.0, 3.0]), (24, [-5.0, 0.5]), (None, [1.0, 2.0, 3.0]), (25, [1.0, 2.0, 3.0]), (7, [-1.0])]
    assert top(spark, rows) == top_by_hand(rows, 5, 4)
    assert top(spark, rows, k=100) == top_by_hand(rows, 100, 4)
    assert top(spark, []) == [] and top(spark, [(4, [1.0])]) == [] and top(spark, [(0, None)]) == []


def test_products_beyond_doubles_are_exact(spark):
    big = [(i, [float(1 << 21) + i, 3.0 * i, float(1 << 22)]) for i in range(30)]
    assert top(spark, big) == top_by_hand(big, 5, 4)
    with pytest.raises(Exception, match="64 bits"):
        top(spark, [(0, [1e13]), (1, [1e13])])


def test_coordinates_leave_all_that_reach_a_cosine():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(500, 6))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ask, cosine = unit[::7], np.full(len(unit[::7]), 0.98)
    picked = products.pick(unit, ask, cosine)
    assert sum(p is not None for p in picked) > len(picked) / 2
    for q, rows in zip(ask, picked):
        if rows is not None:
            assert set(np.flatnonzero(unit @ q >= 0.98)) <= set(rows) and len(rows) < 100


@pytest.mark.parametrize("n,width", [(1, 4), (3, 7), (80, 1), (400, 9)])
def test_rank_one_updates_and_joins_give_the_scatter(n, width):
    rng = np.random.default_rng(n)
    x = np.floor(rng.normal(size=(n, width)) * 8)
    x[n // 2 :: 2] = x[0]
    if width > 3:
        x[:, 2] = x[:, 1]
    away = x - x.mean(axis=0)
    for cut in (n, n // 3, 0):
        one, two = Spectrum.empty(width), Spectrum.empty(width)
        for v in x[:cut]:
            one.add(v)
        for v in x[cut:]:
            two.add(v)
        one.join(two)
        spelled = one.vectors * one.values @ one.vectors.T
        assert np.allclose(spelled, away.T @ away, atol=1e-9 * max(1, n)) and np.allclose(one.mean, x.mean(axis=0))
        assert np.allclose(one.vectors.T @ one.vectors, np.eye(width), atol=1e-12)
        assert one.n == n and (np.diff(one.values) >= 0).all()


def test_rank_one_with_close_and_equal_values():
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    values = np.array([0.0, 0.0, 1.0, 1.0, 1.0 + 1e-14, 1.0 + 1e-9, 5.0, 5e6])
    for v in (rng.normal(size=8), basis[:, 2], np.zeros(8), basis[:, 0] * 1e-9, 1e4 * (basis[:, 6] + basis[:, 7])):
        new, vectors = rank_one(values, basis, v)
        want = basis * values @ basis.T + np.outer(v, v)
        assert np.abs(vectors * new @ vectors.T - want).max() < 1e-14 * 40 * np.abs(want).max()
        assert np.allclose(new, np.linalg.eigvalsh(want), atol=1e-13 * new[-1])
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-13)


def whitened_by_hand(rows):
    width = max((len(v) for _, v in rows if fit_for(v)), default=0)
    x = np.array([whole(v, width) for _, v in rows if fit_for(v)], dtype="int64") + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.astype(object).sum(axis=0)
    mean = fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    deviation = [int(sum((n * int(c) - s) ** 2 for c, s in zip(r, sums))) for r in x]
    return n, deviation, (x - mean) @ vectors[:, :16], values[:16], values.sum()


def check_whitened(got, rows):
    given = [i for i, v in rows if fit_for(v)]
    n, deviation, placed, values, trace = whitened_by_hand(rows)
    c = len(values)
    assert len(got) == len(given) * c and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    for i, d, p in zip(given, deviation, placed):
        mine = sorted(by[i, d], key=lambda r: r["component"])[:: len(by[i, d]) // c]
        assert [r["component"] for r in mine] == list(range(1, c + 1))
        for r, v, e in zip(mine, p, values):
            some = e > 1e-9 * max(trace, 1e-300)
            assert abs(abs(r["whitened"]) - (abs(v) / math.sqrt(e) if some else 0)) < 1e-6
            assert abs(r["explained"] - (e / trace if trace else 0)) < 1e-6 and r["identity_error"] < 1e-9


def test_whitening_of_all_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = op13_whitening(spark, SF_DIR).collect()
    check_whitened(got, rows)
    # one sign for all rows, and white over the fit list
    w = np.array([r["whitened"] for r in sorted(got, key=lambda r: (r["vec_id"], r["component"]))]).reshape(-1, 16)
    assert np.abs(w.T @ w / len(w) - np.eye(16)).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, r.tolist()) for i, r in enumerate(rng.normal(size=(40, 3)) * [3.0, 1.0, 0.4])]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [float("-inf"), 1.0, 1.0]), (103, [2.5]), (None, [1.0, 1.0, 1.0])]
    rows += [(200 + i, [9.0, 9.0, 9.0]) for i in range(60)]
    check_whitened(whitening.whiten(table(spark, rows)).collect(), rows)
    same = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    check_whitened(whitening.whiten(table(spark, same)).collect(), same)
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0


def test_spectra_of_many_tasks_meet_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    rows = [(i, r.tolist()) for i, r in enumerate(rng.normal(size=(50, 4)))]
    x, width = whitening.vectors(table(spark, rows).repartition(7))
    model = whitening.fit(x.repartition(7), width)
    want = whitened_by_hand(rows)
    assert model.centre.n == 50 and np.allclose(model.values, want[3])
    assert whitening.identity_error(x, width, model) < 1e-12


def test_deviations_are_exact_or_null():
    centre = whitening.Centre(10**9, np.array([10**15 + 7, 10**15 - 9], dtype=object))
    x = np.array([[10**6, 10**6 + 3], [10**6 + 40, 10**6]])
    want = [sum((10**9 * int(c) - s) ** 2 for c, s in zip(r, centre.sums)) for r in x]
    assert centre.deviations(x) == [d if d < 1 << 63 else None for d in want]
    assert None in centre.deviations(x)
    assert whitening.exact_sums(np.full((4, 1), (1 << 53) - 1))[0] == 4 * ((1 << 53) - 1)

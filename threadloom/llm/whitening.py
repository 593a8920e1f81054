"""Whitening of embeddings by an eigendecomposition that grows with the rows.

Vectors become whole numbers, and each distinct one is fitted on once. Every
task takes its vectors one by one: a rank-one update of its count, mean and
spectrum for each (``spectra``). The spectra of up to ``FAN`` tasks are joined
in a task by further rank-one updates, level by level, until one is left. One
more pass projects the centred vectors on its basis, and the eigenvectors of
that small matrix (Rayleigh-Ritz) take away what rounding the updates gathered.

Sums are exact whole numbers, and what is subtracted from a vector is the exact
mean. Only states of ``width ** 2`` numbers leave a task or reach the driver.

Defined results: vectors that are null or hold null or non-finite entries are
left out, shorter ones end in zeros. Repeated rows and null keys each get their
rows of the result. A direction without variance has whitened 0 and explained 0
and does not count in ``identity_error``. A deviation that does not fit 64 bits
is null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.spectra import EPS, Spectrum
from threadloom.llm.tables import stored
from threadloom.llm.vectors import matrix, whole, width_of

SCALE = 64.0
SHIFT = 1_000_000
COMPONENTS = 16
#: states that meet in one task
FAN = 16
#: rows projected at a time
ROWS = 2048
STATE = "part bigint, state binary"
_LOW = 26


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python's whole numbers, which do not overflow."""
    high, low = (x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0)
    return high.astype(object) * (1 << _LOW) + low.astype(object)


@dataclass
class Centre:
    """Count and exact sums of the fit list; sums are ``n * floor + rest``."""

    n: int
    sums: np.ndarray

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        floor = self.sums // self.n
        return floor.astype("int64"), (self.sums - floor * self.n).astype("int64")

    def away(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``."""
        floor, rest = self.parts()
        return (x - floor) - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n * x - sums) ** 2`` of each row; None beyond 64 bits."""
        floor, rest = self.parts()
        off = x - floor
        most = (float(np.abs(off).max(initial=0)) + 1) * self.n
        if most**2 * x.shape[1] < 1 << 62:
            return ((off * self.n - rest) ** 2).sum(axis=1).tolist()
        exact = off.astype(object) * self.n - rest.astype(object)
        return [d if d < 1 << 63 else None for d in (exact**2).sum(axis=1)]


@dataclass
class Whitening:
    """Eigenvalues, falling, and unit eigenvectors in columns, of the fit list's covariance."""

    centre: Centre
    values: np.ndarray
    components: np.ndarray
    trace: float

    def scales(self) -> np.ndarray:
        """What a projection is multiplied with; 0 where there is no variance."""
        some = self.values > EPS * len(self.values) * self.values.max(initial=0.0)
        with np.errstate(divide="ignore"):
            return np.where(some, 1 / np.sqrt(np.where(some, self.values, 1.0)), 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        c = min(COMPONENTS, len(self.values))
        return self.centre.away(x) @ self.components[:, :c] * self.scales()[:c]


def _states(rows: DataFrame, start: Callable[[], Any], take: Callable[[Any, np.ndarray], Any], width: int) -> DataFrame:
    """``part, state``: what each task gathers from its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, state, met = TaskContext.get().partitionId(), start(), False
        for batch in batches:
            x = matrix(batch.column(0), width)
            for at in range(0, len(x), ROWS):
                state, met = take(state, x[at : at + ROWS]), True
        if met:
            yield pa.RecordBatch.from_pydict({"part": [part], "state": [pickle.dumps(state)]})

    return rows.select("x").mapInArrow(run, STATE)


def _reduced(states: DataFrame, join: Callable[[Any, Any], Any], name: str) -> Any:
    """All states joined, ``FAN`` in a task at a time; None if there are none."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        held = None
        for state in map(pickle.loads, group["state"]):
            held = state if held is None else join(held, state)
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "state": [pickle.dumps(held)]})

    states = stored(states, name)
    while states.count() > 1:
        states = stored(states.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(meet, STATE), name)
    row = states.first()
    return pickle.loads(row["state"]) if row else None


def vectors(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, int]:
    """``id, x`` stored, and the number of entries, to which shorter vectors are filled up."""
    rows = stored(whole(df, key, vec, SCALE, SHIFT), "vectors")
    width = width_of(rows)
    gap = F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", gap)).otherwise(F.col("x"))), width


def fit(rows: DataFrame, width: int) -> Whitening | None:
    """The whitening of each vector of ``rows`` once; None without vectors."""

    # states are plain arrays: the worker's classes are sent by value and have no name to be read by
    def start() -> dict[str, Any]:
        return {"sums": np.zeros(width, dtype=object), **vars(Spectrum.empty(width))}

    def spectrum_of(state: dict[str, Any]) -> Spectrum:
        return Spectrum(**{k: v for k, v in state.items() if k != "sums"})

    def take(state: dict[str, Any], x: np.ndarray) -> dict[str, Any]:
        spectrum = spectrum_of(state)
        for v in (x - SHIFT).astype("float64"):
            spectrum.add(v)
        return {"sums": state["sums"] + exact_sums(x), **vars(spectrum)}

    def join(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
        spectrum = spectrum_of(a)
        spectrum.join(spectrum_of(b))
        return {"sums": a["sums"] + b["sums"], **vars(spectrum)}

    grown = _reduced(_states(rows, start, take, width), join, "spectra")
    if grown is None:
        return None
    centre = Centre(grown["n"], grown["sums"])
    basis = np.linalg.qr(grown["vectors"])[0]

    def project(held: np.ndarray, x: np.ndarray) -> np.ndarray:
        placed = centre.away(x) @ basis
        return held + placed.T @ placed

    small = _reduced(
        _states(rows, lambda: np.zeros((width, width)), project, width), lambda a, b: a + b, "projected"
    )
    small = (small + small.T) / (2 * centre.n)
    values, turn = np.linalg.eigh(small)
    components = (basis @ turn)[:, ::-1]
    first = np.argmax(np.abs(components) > 0.999 * np.abs(components).max(axis=0), axis=0)
    components = components * np.sign(components[first, np.arange(width)])
    return Whitening(centre, np.maximum(values[::-1], 0.0), components, float(np.trace(small)))


def identity_error(rows: DataFrame, width: int, model: Whitening) -> float:
    """The largest entry of the whitened covariance less the identity, over the fit list."""
    c = min(COMPONENTS, width)

    def take(held: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = model.whiten(x)
        return held + w.T @ w

    found = _reduced(_states(rows, lambda: np.zeros((c, c)), take, width), lambda a, b: a + b, "identity")
    return float(np.abs(found / model.centre.n - np.diag((model.scales()[:c] > 0) * 1.0)).max(initial=0.0))


def whiten(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Per vector and component: ``<key>, component, n, deviation, whitened, explained, identity_error``."""
    rows, width = vectors(df, key, vec)
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    distinct = stored(rows.select("x").distinct(), "fit")
    model = fit(distinct, width) if width else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, width, model)
    c = min(COMPONENTS, width)
    explained = (model.values[:c] / model.trace if model.trace > 0 else np.zeros(c)).tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x, m = matrix(some.column(1), width), some.num_rows
                each = np.repeat(np.arange(m), c)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, c + 1, dtype="int32"), m)),
                        pa.array(np.full(m * c, model.centre.n)),
                        pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(model.whiten(x).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * c, error)),
                    ],
                    names=schema.names,
                )

    return rows.select("id", "x").mapInArrow(run, schema)

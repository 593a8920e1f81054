"""Caller-supplied models as batched jobs.

A provider is a name with a plain function, ``embed(list[str]) -> vectors`` or
``complete(system, user) -> str``. Providers are tried in the given order.
Tasks may be retried by Spark, so a provider must be safe to call again.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from threadloom.sizing import spread

Embed = Callable[[list[str]], Sequence[Sequence[float]]]
Complete = Callable[[str, str], str]

EMBEDDED = [
    T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False)),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("embedding_usage", T.MapType(T.StringType(), T.LongType())),
]
ANSWERED = [T.StructField(name, T.StringType()) for name in ("reply", "reply_model", "error")]

#: prompts that a task answers at a time, and hands on, per worker
PROMPTS_PER_WORKER = 8


def _with_retry(call: Callable[[], object], attempts: int, wait: float) -> object:
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(random.uniform(0, wait * 2**attempt))


def _first_answer(
    providers: Sequence[tuple[str, Callable]], args: tuple, attempts: int, wait: float
) -> tuple[str, object]:
    """Answer of the first provider that gives one; the last failure is raised."""
    failure: Exception | None = None
    for name, provider in providers:
        try:
            return name, _with_retry(lambda: provider(*args), attempts, wait)
        except Exception as error:
            failure = error
    raise failure if failure else ValueError("no provider given")


def _answered(
    df: DataFrame,
    asked: Sequence[str],
    fields: Sequence[T.StructField],
    size: int,
    answers: Callable[..., Sequence[Sequence]],
) -> DataFrame:
    """``df`` with ``fields``, of which ``answers`` makes rows from lists of the ``asked`` columns.

    Of a batch only ``size`` rows at a time become Python values, and only in the
    asked columns: a task's memory does not grow with the rows of a batch, whose
    other columns are handed on as they came.
    """
    at = [df.columns.index(c) for c in asked]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*df.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                found = answers(*[part.column(i).to_pylist() for i in at])
                added = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)
                del part
            # gone before the next one comes
            del batch

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def embed_texts(
    df: DataFrame,
    text_col: str,
    providers: Sequence[tuple[str, Embed]],
    batch_size: int = 100,
    attempts: int = 3,
    wait: float = 1.0,
    dealt: bool = False,
) -> DataFrame:
    """Add ``embedding``, ``embedding_model`` and ``embedding_usage``.

    One call per ``batch_size`` texts. A null text is not sent and gets nulls.
    A batch no provider can embed fails the task, and after Spark's own retries
    the job. ``dealt`` says that the rows are in tasks of the caller's choice.
    """
    providers = list(providers)

    def answers(column: list) -> list[tuple]:
        texts = [t for t in column if t is not None]
        name, vectors = _first_answer(providers, (texts,), attempts, wait) if texts else (None, [])
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(vectors)} vectors")
        found = (
            (list(map(float, v)), name, [("prompt_tokens", max(1, len(t) // 4))])
            for t, v in zip(texts, vectors)
        )
        return [(None, None, None) if t is None else next(found) for t in column]

    return _answered(df if dealt else spread(df), [text_col], EMBEDDED, batch_size, answers)


def complete_prompts(
    df: DataFrame,
    system_col: str,
    user_col: str,
    providers: Sequence[tuple[str, Complete]],
    attempts: int = 1,
    wait: float = 1.0,
    max_workers: int = 8,
    dealt: bool = False,
) -> DataFrame:
    """Add ``reply``, ``reply_model`` and ``error``; a failed prompt keeps its row.

    Each task makes up to ``max_workers`` calls at once. Rows keep their order
    and are handed on in small slices. ``dealt`` says that they are in tasks of
    the caller's choice.
    """
    providers = list(providers)

    def answer(system: str, user: str) -> tuple[str | None, str | None, str | None]:
        try:
            name, reply = _first_answer(providers, (system, user), attempts, wait)
            return reply, name, None
        except Exception as error:
            return None, None, f"{type(error).__name__}: {error}"

    def answers(systems: list, users: list) -> list[tuple]:
        with ThreadPoolExecutor(max_workers) as pool:
            return list(pool.map(answer, systems, users))

    size = PROMPTS_PER_WORKER * max_workers
    return _answered(df if dealt else spread(df), [system_col, user_col], ANSWERED, size, answers)


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places of a prompt; a null value fills in as empty.

    Values are put in one pass over the template, so braces inside a value
    stay as they are.
    """
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")

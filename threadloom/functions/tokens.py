"""Token counts, as functions from lists of lists of strings to their counts.

The nested form lets one chunking plan serve a native estimate, which stays in
the JVM, and a real tokenizer, which takes whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TokenCounter = Callable[[Column], Column]


def estimate(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def estimate_counts(lists: Column) -> Column:
    return F.transform(lists, lambda texts: F.transform(texts, estimate))


def tokenizer_counts(load: Callable[[], Callable[[list[str]], Iterable[list[int]]]]) -> TokenCounter:
    """Counts by a real tokenizer.

    ``load`` runs once per Python worker and returns a function that encodes a
    list of texts.
    """
    held: list = []

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def count(batch: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        flat = [t for lists in batch if lists is not None for texts in lists for t in texts]
        sizes = iter([len(ids) for ids in held[0](flat)] if flat else [])
        return batch.map(
            lambda lists: [[next(sizes) for _ in texts] for texts in lists], na_action="ignore"
        )

    return count

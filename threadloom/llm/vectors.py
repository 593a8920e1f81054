"""Embeddings as vectors of whole numbers, in Spark and in Arrow batches.

A vector that is null, or that holds a null, infinite or not-a-number entry or
one beyond 2**53 after scaling, is left out. A shorter vector counts as ending
in zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = float(1 << 53)


def _odd(c: Column, scale: float) -> Column:
    wide = c.cast("double")
    return c.isNull() | F.isnan(wide) | (F.abs(wide * scale) >= EXACT)


def whole(df: DataFrame, key: str, vec: str, scale: float, shift: int = 0) -> DataFrame:
    """``id`` and ``x``: every entry scaled, rounded down and shifted; unfit vectors left out."""
    vector = F.col(vec)
    # a test within the conditional, since a filter may run after the conversion
    fit = vector.isNotNull() & ~F.exists(vector, lambda c: _odd(c, scale))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("bigint"))
    rows = df.select(F.col(key).alias("id"), F.when(fit, x).alias("x"))
    return rows.where("x IS NOT NULL")


def width_of(rows: DataFrame) -> int:
    """The greatest number of entries of a vector, 0 for an empty table."""
    return rows.agg(F.max(F.size("x"))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``width`` numbers."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), dtype="int64")
    out[np.arange(width) < sizes[:, None]] = flat
    return out

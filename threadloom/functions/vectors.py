"""Vector columns, as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_text(c: Column) -> Column:
    """A vector written as ``[0.1, 0.2]`` text."""
    return F.from_json(c, "array<double>")

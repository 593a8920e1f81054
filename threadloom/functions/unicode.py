"""Folding text to ASCII by compatibility decomposition (NFKD).

Spark has no normalisation function, so this is a vectorised Python call, but
only texts that need it leave the JVM: for the others the call is given null.
(A ``translate`` table for accented Latin letters was measured and is slower.)
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _fold_batch(texts: pd.Series) -> pd.Series:
    def fold(t: str) -> str:
        return unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")

    return texts.map(fold, na_action="ignore")


def fold_ascii(c: Column) -> Column:
    """NFKD with everything outside ASCII dropped."""
    wide = F.octet_length(c) > F.length(c)
    return F.when(wide, _fold_batch(F.when(wide, c))).otherwise(c)

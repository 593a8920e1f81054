"""Small tables with everything that goes wrong in large ones."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: columns whose names the operators use for their own
CLASHING = ("key", "fp", "h", "c", "own", "hit", "row", "rank", "part", "length", "digest", "score", "spans", "n_words")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]]) -> DataFrame:
    rows = [(i, t, None if n % 3 else "en", "s", None if t is None else len(t)) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "river", "stone", "quiet", "über", "niño", "walks", "under", "bright", "morning"]
    vocabulary += [f"word{i}" for i in range(400)]
    common = ["the", "of", "and", "der", "la"]
    return " ".join(rng.choice(vocabulary if rng.random() < 0.7 else common) + ("." if rng.random() < 0.1 else "") for _ in range(n))

"""From raw documents to packed training sequences: five stages, each one operator.

Every stage takes the documents its predecessor kept, from Parquet, and returns
documents of the same columns; the last returns the pieces of sequences. Texts
that a stage changes get their new length where the table has ``n_chars``.

Defined results: each stage treats null and empty texts, null and repeated keys
as its operator says; the quality rules reject null and empty texts, so later
stages meet none of them. Rows that repeat key and text are one document after
the second stage. An empty table gives no sequences. Columns that the operators
do not know pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, packing, pii, quality_rules, simhash
from threadloom.llm.packing_queries import encoder, tokenizer_path
from threadloom.llm.tables import own_folder, read, stored


def _measured(docs: DataFrame) -> DataFrame:
    """The length column brought up to date with the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality_rules.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates: four-word fingerprints within four bits."""
    own_folder(spark)
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark."""
    return _measured(decontaminate.remove_spans(docs, read(spark, sf_dir, "benchmark")))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return _measured(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    own_folder(spark)
    return packing.pack(docs, encoder(tokenizer_path()))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_benchmark),
    ("pii", hide_personal),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: fingerprints, fitted trees and token ids are not SQL's to express
ORACLE_SQL = None

"""Queries of the operators that are fitted here: main text, quality, toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import html_extract, quality_model, toxicity
from threadloom.llm.labelled import fold
from threadloom.llm.tables import read

POSITIVE = 0.7


def op1_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(read(spark, sf, "pages")).drop("kept_blocks", "blocks")


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    positives = labels.where("quality = 1").where(fold(F.col("doc_id"), 4) != 2)
    net = quality_model.fit(docs, positives)
    scored = docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        quality_model.score(F.col("text"), net).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= POSITIVE).cast("int"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    scored = docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        toxicity.score(F.col("text"), model).alias("s"),
    )
    return scored.select(
        "doc_id",
        "held_out",
        F.col("s.score").alias("score"),
        (F.col("s.score") >= POSITIVE).cast("int").alias("predicted"),
        F.size("s.sentences").alias("n_offending"),
    )


QUERIES = {f.__name__: f for f in (op1_main_text, op2_quality, op4_toxicity)}
ORACLES: dict[str, str] = {}

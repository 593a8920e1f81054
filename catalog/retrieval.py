"""Embedding and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import read, shown, sql_embed, sql_shown, stub_embed
from threadloom.operators import similarity
from threadloom.operators.cells import build_index, top_threads_in_cells
from threadloom.operators.ledger import embed_once
from threadloom.operators.models import embed_texts
from threadloom.session import scratch_path


def _first_vector(vectors):
    return vectors.filter("vec_id = 0").select("embedding").first()[0]


def sim_score(spark, sf):
    v = read(spark, sf, "embeddings")
    return similarity.score(v, _first_vector(v)).select(
        "vec_id", F.round("similarity", 6).alias("similarity")
    )


def sim_top(spark, sf):
    v = read(spark, sf, "embeddings")
    top = similarity.top_similar(v, _first_vector(v), 100, "vec_id", ["label"])
    return top.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "rank")


def sim_top_threads(spark, sf):
    v = read(spark, sf, "embeddings")
    found = similarity.top_threads(v, _first_vector(v), 8, "vec_id", "label", ["label"])
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "rank")


def sim_many_queries(spark, sf):
    """Every fiftieth vector of the table as a query."""
    v = read(spark, sf, "embeddings")
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = similarity.top_threads(v, queries, 5, "vec_id", "label", ["label"])
    return found.select(
        "query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"), "rank"
    )


def sim_cells(spark, sf):
    """The same queries, each the best row of its three best threads, from an index of cells."""
    v = read(spark, sf, "embeddings")
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = build_index(v, scratch_path(spark, "cells"), "vec_id", "label")
    found, _ = top_threads_in_cells(v, index, queries, 3, ["label"])
    return found.select(
        "query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"), "rank"
    )


def emb_texts(spark, sf):
    """Batched embedding with a provider that always fails before one that works."""

    def broken(texts):
        raise ConnectionError("down")

    d = read(spark, sf, "documents").select("doc_id", "text")
    e = embed_texts(d, "text", [("broken", broken), ("stub", stub_embed)], 64, attempts=1)
    return e.select(
        "doc_id",
        shown("embedding").alias("vector"),
        F.col("embedding_model").alias("model"),
        F.try_element_at("embedding_usage", F.lit("prompt_tokens")).alias("tokens"),
    )


def emb_ledger(spark, sf):
    """Texts of labelled documents first, then all, and those without a text, through one ledger."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    missing = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    path = scratch_path(spark, "vectors")
    for asked in (labelled, docs.unionByName(missing)):
        done = embed_once(asked, "text", [("stub", stub_embed)], path)
    return done.select("doc_id", shown("embedding").alias("vector"), F.col("embedding_model").alias("model"))


QUERIES = {
    f.__name__: f
    for f in (sim_score, sim_top, sim_top_threads, sim_many_queries, sim_cells, emb_texts, emb_ledger)
}

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SCORED = f"""scored AS (SELECT e.vec_id, e.label, {_COS} AS s
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def threads_sql(k: int, by: str, source: str) -> str:
    return f"""firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}, label
            ORDER BY round(s, 9) DESC, vec_id) AS f FROM {source}) WHERE f = 1),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by}
            ORDER BY round(s, 9) DESC, vec_id) AS INT) AS rank FROM firsts)"""


ORACLES = {
    "sim_score": f"WITH {_SCORED} SELECT vec_id, round(round(s, 9), 6) AS similarity FROM scored",
    "sim_top": f"""WITH {_SCORED} SELECT vec_id, label, round(round(s, 9), 6) AS similarity,
        CAST(row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS INT) AS rank
        FROM scored ORDER BY rank LIMIT 100""",
    "sim_top_threads": f"""WITH {_SCORED}, one AS (SELECT *, 0 AS q FROM scored), {threads_sql(8, 'q', 'one')}
        SELECT vec_id, label, round(round(s, 9), 6) AS similarity, rank FROM ranked WHERE rank <= 8""",
    "sim_many_queries": f"""WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_COS} AS s
          FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), {threads_sql(5, 'query_id', 'pairs')}
        SELECT query_id, vec_id, label, round(round(s, 9), 6) AS similarity, rank FROM ranked WHERE rank <= 5""",
    "sim_cells": f"""WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_COS} AS s
          FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), {threads_sql(3, 'query_id', 'pairs')}
        SELECT query_id, vec_id, label, round(round(s, 9), 6) AS similarity, rank FROM ranked WHERE rank <= 3""",
    "emb_ledger": f"""SELECT doc_id, {sql_shown(sql_embed('text'))} AS vector, 'stub' AS model FROM documents
        UNION ALL SELECT -doc_id - 1, NULL, NULL FROM documents""",
    "emb_texts": f"""SELECT doc_id, {sql_shown(sql_embed('text'))} AS vector, 'stub' AS model,
        CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents""",
}

"""From subsets to a knowledge base, and from a query to its summary."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.hashing import row_hash
from threadloom.functions.tokens import TokenCounter, estimate_counts
from threadloom.operators import summary as S
from threadloom.operators.chunking import chunk_posts
from threadloom.operators.ledger import complete_once, embed_once
from threadloom.operators.models import Complete, Embed, complete_prompts, embed_texts, render
from threadloom.operators.replies import parse_replies
from threadloom.operators.similarity import top_threads
from threadloom.operators.times import temporal_extent
from threadloom.session import materialise
from threadloom.sources.readers import read_knowledge_base, read_subsets
from threadloom.sources.writers import build_if_absent, has_rows

SYSTEM_PROMPT = (
    "You read chunks of message-board posts and report early signals. First give lines of "
    "the form (t, metric, value, confidence). Then, after <signal_context>, give four headed "
    "bullet lists: key claims detected, supporting text, risk assessment, viral potential."
)
CHUNK_PROMPT = "Report on this content:\n\n<content>\n{content}\n</content>"
SUMMARY_SYSTEM_PROMPT = "You summarise analyses of message-board posts."
SUMMARY_PROMPT = (
    "Question: {query}\n\n{temporal_context}\n\nContext:\n{context}\n\nAnalyses:\n{results}\n\n"
    "Write one summary for the time from {start_date} to {end_date}."
)


@dataclass(frozen=True)
class Models:
    """Functions that stand for models, in order of preference, and their prompts.

    With a ``ledger``, a folder, what they answer is kept there and never asked
    for again, by this job or a later one; ``parameters`` tell answers apart
    that the same models give under other settings.
    """

    embed: Sequence[tuple[str, Embed]]
    complete: Sequence[tuple[str, Complete]]
    summarize: Sequence[tuple[str, Complete]] = field(default=())
    system_prompt: str = SYSTEM_PROMPT
    chunk_prompt: str = CHUNK_PROMPT
    summary_system_prompt: str = SUMMARY_SYSTEM_PROMPT
    summary_prompt: str = SUMMARY_PROMPT
    ledger: str | None = None
    parameters: dict[str, object] = field(default_factory=dict)

    def completer(self) -> Callable[..., DataFrame]:
        if self.ledger is None:
            return complete_prompts
        return partial(complete_once, ledger=f"{self.ledger}/replies", parameters=self.parameters)


def build_knowledge_base(
    spark: SparkSession,
    subsets: str,
    knowledge_base: str,
    embed: Sequence[tuple[str, Embed]],
    batch_size: int = 100,
    ledger: str | None = None,
    parameters: dict[str, object] | None = None,
) -> bool:
    """Embed all subset posts into a Parquet table, unless it is there already.

    A post without a text gets no vector. With a ``ledger``, a build that broke
    off asks only for what is missing.
    """
    if ledger is not None and has_rows(spark, knowledge_base):
        return False
    posts = read_subsets(spark, subsets)
    if ledger is None:
        embedded = embed_texts(posts, "text_clean", embed, batch_size)
    else:
        store = f"{ledger}/vectors"
        embedded = embed_once(posts, "text_clean", embed, store, parameters or {}, batch_size)
    table = embedded.select(
        "thread_id",
        F.col("posted_date_time").try_cast("timestamp").alias("posted_date_time"),
        F.col("text_clean").alias("text"),
        "embedding",
    )
    return build_if_absent(table, knowledge_base)


def analyse_chunks(chunks: DataFrame, models: Models) -> DataFrame:
    """Ask the model about each chunk and read its replies.

    The replies are stored first: read twice, they would be asked for twice.
    """
    prompted = chunks.withColumns(
        {
            "_system": F.lit(models.system_prompt),
            "_user": render(models.chunk_prompt, content=F.col("text")),
        }
    )
    replies = models.completer()(prompted, "_system", "_user", models.complete)
    return parse_replies(materialise(replies.drop("_system", "_user")))


def summarise(
    posts: DataFrame, queries: DataFrame, analyses: DataFrame, models: Models
) -> DataFrame:
    """One summary per query from its posts' times and its chunks' analyses."""
    good = analyses.filter(F.col("error").isNull())
    by, order = ["query_id"], ["rank", "seq"]
    parts = good.groupBy(*by).agg(
        S.joined_texts(F.col("analysis.thread_analysis"), order).alias("combined_summary"),
        S.joined_texts(S.context_block(F.col("context")), order).alias("combined_context"),
        S.joined_texts(S.analysis_section(F.col("reply")), order).alias("structured_results"),
        S.event_map(F.col("reply"), order).alias("event_map"),
    )
    parts = parts.join(temporal_extent(posts, "posted_date_time", *by), by)
    full = queries.select("query_id", "query").join(parts, by, "left")
    full = full.fillna("", ["combined_summary", "combined_context", "structured_results"])
    full = full.fillna("{}", ["event_map"])
    providers = models.summarize or models.complete
    return S.final_summary(
        full, providers, models.summary_system_prompt, models.summary_prompt, complete=models.completer()
    )


def run_queries(
    kb: DataFrame,
    queries: DataFrame,
    models: Models,
    k: int = 100,
    key: str = "id",
    limit: int = 1000,
    counter: TokenCounter = estimate_counts,
) -> tuple[DataFrame, DataFrame]:
    """Chunks with their analyses, and one summary per (query_id, query) row.

    ``kb`` is read twice, so its vectors should be stored. Every model is asked
    once per query, chunk and summary; the results can be read again for free.
    """
    # stored: retrieval reads the vectors more than once
    vectors = materialise(embed_texts(queries, "query", models.embed).select("query_id", "embedding"))
    found = materialise(top_threads(kb, vectors, k, key))
    chunks = chunk_posts(found, limit=limit, counter=counter)
    analyses = analyse_chunks(chunks, models)
    return analyses, summarise(found, queries, analyses, models)


def run_knowledge(
    spark: SparkSession,
    query: str,
    subsets: str,
    knowledge_base: str,
    models: Models,
    k: int = 100,
    batch_size: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Build the knowledge base where needed, then answer one query from it."""
    build_knowledge_base(
        spark, subsets, knowledge_base, models.embed, batch_size, models.ledger, models.parameters
    )
    kb = read_knowledge_base(spark, knowledge_base)
    kb = kb.withColumn("id", row_hash(["thread_id", "posted_date_time", "text"], 0))
    queries = spark.createDataFrame([(0, query)], "query_id long, query string")
    return run_queries(kb, queries, models, k)

"""Answers of models that outlive the job that asked for them.

A ledger is a Parquet table of answers under the digest of what was asked: the
model, its parameters and the text. Asking through it looks up what is known,
asks each unknown question once however many rows ask it, and joins the answers
back to all rows. Questions are dealt out in small tasks, and each task's answers
stay once it has finished, whatever becomes of the job: one that died at nine
tenths asks a tenth again, and the questions of the tasks that were running.

Questions whose call failed are entered with their error and asked again next
time; an answer, once there, is never asked for again. A null part of a question
counts as absent, which differs from empty. Several jobs may add to one ledger;
the same question may then be asked by each, and the first entry is taken.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.models import Complete, Embed, complete_prompts, embed_texts
from threadloom.sizing import broadcast_measured
from threadloom.sources.writers import has_rows

#: questions of one task, which is what a lost task asks again
TASK_QUESTIONS = 256

#: committed by the task, not with the job
COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

REPLIES = "reply string, reply_model string, error string"
VECTORS = "embedding array<float>, embedding_model string, embedding_usage map<string,bigint>"


def question_key(parts: Sequence[Column], models: Sequence[str], parameters: Mapping[str, object]) -> Column:
    """Digest of a question: its parts in order, the models' names, and parameters by name."""
    asked = json.dumps([list(models), dict(parameters)], sort_keys=True, default=str)
    # each part behind its length, so that no two lists of parts spell the same
    spelled = [
        F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.length(p).cast("string"), F.lit(":"), p)) for p in parts
    ]
    return F.sha2(F.concat_ws("|", F.lit(asked), *spelled), 256)


def read_ledger(spark: SparkSession, path: str, answer: str) -> DataFrame:
    """Entries ``_key``, the answer's columns, ``_failed`` and ``_at``."""
    schema = T.StructType(
        [
            T.StructField("_key", T.StringType()),
            *T._parse_datatype_string(answer).fields,
            T.StructField("_failed", T.BooleanType()),
            T.StructField("_at", T.TimestampType()),
        ]
    )
    if not has_rows(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def best_entries(ledger: DataFrame) -> DataFrame:
    """One entry per key: the first answer, or else the last failure."""
    answers = [f for f in ledger.schema.fields if f.name not in ("_key", "_failed", "_at")]
    # a hash takes a map as its entries
    hashed = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in answers]
    micros = F.unix_micros("_at")
    order = F.struct("_failed", F.when(F.col("_failed"), -micros).otherwise(micros), F.xxhash64(*hashed))
    best = ledger.groupBy("_key").agg(F.min_by(F.struct(*[f.name for f in answers], "_failed"), order).alias("e"))
    return best.select("_key", "e.*")


def ask_once(
    df: DataFrame,
    key: Column,
    columns: Sequence[str],
    path: str,
    answer: str,
    ask: Callable[[DataFrame], DataFrame],
    failed: Column,
    task_questions: int = TASK_QUESTIONS,
) -> DataFrame:
    """``df`` with the answer's columns, from the ledger at ``path``.

    ``ask`` answers a frame of ``_key`` and ``columns``; ``failed`` tells which of
    its rows are no answers. Rows with a null key are not asked.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", key)
    known = best_entries(read_ledger(spark, path, answer)).where(~F.col("_failed")).select("_key")
    # equal questions meet in one row before anything is asked
    wanted = keyed.select("_key", *columns).where("_key IS NOT NULL").dropDuplicates(["_key"])
    wanted = wanted.join(known, "_key", "left_anti")
    names = [f.name for f in T._parse_datatype_string(answer).fields]
    n = wanted.count()
    if n:
        # by another expression than the rows met by, else the tasks would be theirs
        dealt = wanted.repartition(-(-n // task_questions), F.xxhash64("_key"))
        entry = ask(dealt).select(
            "_key", *names, F.coalesce(failed, F.lit(False)).alias("_failed"), F.current_timestamp().alias("_at")
        )
        entry.write.options(**COMMIT).mode("append").parquet(path)
    entries = best_entries(read_ledger(spark, path, answer)).drop("_failed")
    # of a ledger that many jobs fill, only this one's entries
    entries = entries.join(keyed.select("_key").distinct(), "_key", "left_semi")
    joined = keyed.drop(*names).join(broadcast_measured(entries), "_key", "left")
    kept = [c for c in df.columns if c not in names]
    return joined.select(*kept, *names)


def complete_once(
    df: DataFrame,
    system_col: str,
    user_col: str,
    providers: Sequence[tuple[str, Complete]],
    ledger: str,
    parameters: Mapping[str, object] = {},
    attempts: int = 1,
    wait: float = 1.0,
    max_workers: int = 8,
    task_questions: int = TASK_QUESTIONS,
) -> DataFrame:
    """``complete_prompts`` through a ledger: ``reply``, ``reply_model`` and ``error``."""
    key = question_key([F.col(system_col), F.col(user_col)], [n for n, _ in providers], parameters)

    def ask(wanted: DataFrame) -> DataFrame:
        return complete_prompts(wanted, system_col, user_col, providers, attempts, wait, max_workers, dealt=True)

    columns = list(dict.fromkeys([system_col, user_col]))
    return ask_once(df, key, columns, ledger, REPLIES, ask, F.col("error").isNotNull(), task_questions)


def embed_once(
    df: DataFrame,
    text_col: str,
    providers: Sequence[tuple[str, Embed]],
    ledger: str,
    parameters: Mapping[str, object] = {},
    batch_size: int = 100,
    attempts: int = 3,
    wait: float = 1.0,
    task_questions: int = TASK_QUESTIONS,
) -> DataFrame:
    """``embed_texts`` through a ledger; a null text is not asked and gets nulls."""
    key = question_key([F.col(text_col)], [n for n, _ in providers], parameters)

    def ask(wanted: DataFrame) -> DataFrame:
        return embed_texts(wanted, text_col, providers, batch_size, attempts, wait, dealt=True)

    asked = F.when(F.col(text_col).isNotNull(), key)
    return ask_once(df, asked, [text_col], ledger, VECTORS, ask, F.col("embedding").isNull(), task_questions)

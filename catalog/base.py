"""Tables, derived views and SQL pieces the query modules share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.strings import SPACES
from threadloom.session import CHECKPOINT_CONF, pin_utc, use_folder
from threadloom.sizing import spread

#: white space as the library knows it, for DuckDB's regular expressions
W_RANGES = (
    r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
W = f"[{W_RANGES}]"
NW = f"[^{W_RANGES}]"
SPACES_SQL = "'" + SPACES + "'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {SPACES_SQL})"


def sql_squeeze(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{W}+', ' ', 'g')")


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{W}+'), lambda w: w <> '')"


#: a time with six digits of a second only where it has a fraction
SQL_TIME_TEXT = (
    "CASE WHEN microsecond(posted_date_time) % 1000000 = 0 "
    "THEN strftime(posted_date_time, '%Y-%m-%d %H:%M:%S') "
    "ELSE strftime(posted_date_time, '%Y-%m-%d %H:%M:%S.%f') END"
)


def own_folder(spark: SparkSession) -> SparkSession:
    """A local session without a shared folder gets one; a cluster has to name it."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not named and sc.master.startswith("local"):
        use_folder(spark, tempfile.mkdtemp(prefix="threadloom-"))
    return spark


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin_utc(own_folder(spark)).read.parquet(f"{sf}/{name}.parquet")


def ntz(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts: the event of the same number gives thread and time."""
    d, e = spread(read(spark, sf, "documents")), read(spark, sf, "events")
    return d.join(e, d.doc_id == e.event_id).select(
        "doc_id",
        F.col("user_id").cast("string").alias("thread_id"),
        F.col("ts").cast("timestamp").alias("posted_date_time"),
        "text",
        F.col("source").alias("filename"),
        "lang",
    )


POSTS = """
posts AS (
  SELECT d.doc_id, CAST(e.user_id AS VARCHAR) AS thread_id, e.ts AS posted_date_time,
         d.text, d.source AS filename, d.lang
  FROM documents d JOIN events e ON d.doc_id = e.event_id)
"""

#: posts that refer to other threads, with the same expression in both engines
CITED_TEXT = "concat(text, ' >>', CAST(doc_id * 7 % 50 AS STRING))"


def cited_posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).withColumn("text", F.expr(CITED_TEXT))


CITED = f"{POSTS}, cited AS (SELECT * REPLACE ({CITED_TEXT} AS text) FROM posts)"


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Events as finished steps."""
    return read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").cast("string").alias("step_id"),
        F.col("event_type").alias("step"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.col("value").alias("duration"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("ts").cast("timestamp").alias("ts"),
        "props",
    )


STEPS = """
steps AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(event_id AS VARCHAR) AS step_id,
         event_type AS step, 'p' || CAST(user_id % 3 AS VARCHAR) AS provider,
         value AS duration, event_type = 'error' AS failed, ts, props
  FROM events)
"""

#: model replies of known content, with the same expression in both engines
REPLY = """
CASE WHEN lang = 'de' THEN concat('plain reply about ', CAST(n_chars AS STRING), ' (a, b, 3, 0.5)')
ELSE concat_ws(chr(10),
  concat('(2024-01-01T00:00:00Z, activity, ', CAST(n_chars AS STRING), ', 0.9)'),
  concat('seen (t1, ', lang, '_rate, ', CAST(doc_id AS STRING), '.5, 0.5) here'),
  'no metric in this line', ') out of order (t, x, 1, 1)', '(t, activity, many, 0.1)',
  concat('(t2,  activity , ', CAST(doc_id AS STRING), ', 0.2, more)'), '(two, parts)',
  '<signal_context>',
  'Key claims detected:',
  concat('- "', replace(text, chr(10), ' '), '" was said'),
  concat('* claim of ', source), '', '- ',
  '## Supporting Text', concat('  - seen in ', lang), 'not a bullet',
  'Risk assessment:', '- the risk assessment heading again', concat('- risk ', CAST(doc_id % 7 AS STRING)),
  'Viral Potential', concat('- viral ', CAST(doc_id % 5 AS STRING)))
END
"""


#: ten documents make a thread
THREAD = "CAST(floor(doc_id / 10) AS BIGINT)"


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents")).select(
        "doc_id", F.expr(THREAD).alias("thread_id"), F.expr(REPLY).alias("reply")
    )


REPLIES = f"replies AS (SELECT doc_id, {THREAD} AS thread_id, {REPLY} AS reply FROM documents)"


def stub_embed(texts: list[str]) -> list[list[float]]:
    """Vectors made of digests: no model, but the same numbers in SQL."""
    import hashlib

    def number(text: str, i: int) -> float:
        return int(hashlib.md5(f"{text}|{i}".encode()).hexdigest()[:4], 16) / 65535

    return [[number(t, i) for i in range(8)] for t in texts]


def sql_embed(x: str) -> str:
    return (
        "list_transform(range(8), lambda i: CAST(CAST(('0x' || substr(md5("
        f"{x} || '|' || CAST(i AS VARCHAR)), 1, 4)) AS INT) / 65535.0 AS FLOAT))"
    )


def shown(embedding: str) -> Column:
    """A whole vector as text, in hundred-thousandths."""
    whole = F.transform(embedding, lambda x: F.round(x.cast("double") * 100_000).cast("long").cast("string"))
    return F.array_join(whole, ",")


def sql_shown(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda x: CAST(round(CAST(x AS DOUBLE) * 100000) AS BIGINT)), ',')"


def stub_complete(system: str, user: str) -> str:
    """A reply in the asked-for shape, derived from the lengths of the prompts."""
    return (
        f"(t, prompt_length, {len(user)}, 0.9)\n<signal_context>\n"
        f"Key claims detected:\n- {len(system)} characters of system prompt"
    )

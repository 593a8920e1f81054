"""Model calls, reply parsing and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    REPLIES, read, replies, sql_embed, sql_strip, stub_complete, stub_embed,
)
from catalog.cleaning import VALID_SQL, clean_chunk_sql, framed_sql, packed_sql
from catalog.retrieval import threads_sql
from threadloom.operators import models, replies as R, summary as S
from threadloom.operators.ledger import REPLIES as ANSWERS, complete_once, question_key, read_ledger
from threadloom.operators.reduction import reduce_texts
from threadloom.plans.knowledge import (
    CHUNK_PROMPT, SUMMARY_SYSTEM_PROMPT, SYSTEM_PROMPT, Models, run_queries,
)
from threadloom.session import scratch_path
from threadloom.sources.writers import build_if_absent

NAMES = ["key_claims", "supporting_text", "risk_assessment", "viral_potential"]


def _parsed(spark, sf):
    return R.parse_replies(replies(spark, sf))


def llm_complete(spark, sf):
    """One call per document; the provider fails for German texts."""

    def provider(system: str, user: str) -> str:
        if user.startswith("de:"):
            raise ValueError("no German")
        return stub_complete(system, user)

    d = read(spark, sf, "documents").select(
        "doc_id", F.lit("be brief").alias("system"), F.concat_ws(":", "lang", "text").alias("user")
    )
    done = models.complete_prompts(d, "system", "user", [("stub", provider)])
    return done.select("doc_id", "reply", F.col("reply_model").alias("model"), "error")


def llm_ledger(spark, sf):
    """English documents first, then all through the same ledger; and how often each prompt is entered."""

    def provider(system: str, user: str) -> str:
        if user.startswith("de:"):
            raise ValueError("no German")
        return stub_complete(system, user)

    d = read(spark, sf, "documents").select(
        "doc_id", "lang", F.lit("be brief").alias("system"), F.concat_ws(":", "lang", "text").alias("user")
    )
    path = scratch_path(spark, "answers")
    for asked in (d.where("lang = 'en'"), d):
        done = complete_once(asked, "system", "user", [("stub", provider)], path)
    key = question_key([F.col("system"), F.col("user")], ["stub"], {})
    entries = read_ledger(spark, path, ANSWERS).groupBy("_key").agg(F.count(F.lit(1)).alias("entries"))
    counted = done.withColumn("_key", key).join(entries, "_key")
    return counted.select("doc_id", "reply", F.col("reply_model").alias("model"), "error", "entries")


def llm_render(spark, sf):
    template = "Q {query} in {place}: {content} / {query} {unknown}"
    d = read(spark, sf, "documents")
    text = models.render(
        template, query=F.concat(F.lit("{content}"), F.col("source")), place=F.col("lang"),
        content=F.col("text"),
    )
    return d.select("doc_id", text.alias("prompt"))


def llm_sections(spark, sf):
    parts = R.split_sections(F.col("reply"))
    return replies(spark, sf).select(
        "doc_id", parts["analysis"].alias("analysis"), parts["context"].alias("context"),
        parts["sections"].alias("sections"),
    )


def llm_metric_rows(spark, sf):
    return R.exploded_metrics(replies(spark, sf).drop("thread_id"))


def llm_metrics(spark, sf):
    """Metrics of each reply, the last of equal names."""
    p = _parsed(spark, sf).select("doc_id", F.explode("analysis.metrics").alias("name", "value"))
    return p


def llm_context(spark, sf):
    lists = [F.array_join(F.col(f"context.{n}"), " | ").alias(n) for n in NAMES]
    return _parsed(spark, sf).select("doc_id", *lists)


def llm_sizes(spark, sf):
    return _parsed(spark, sf).select("doc_id", F.explode("metrics").alias("name", "value"))


def sum_context_block(spark, sf):
    return _parsed(spark, sf).select("doc_id", S.context_block(F.col("context")).alias("block"))


def sum_combine(spark, sf):
    c = read(spark, sf, "conversations")
    return S.combine(c, ["conv_id"], ["turn"], "text", "combined")



def sum_tree(spark, sf):
    """All documents of a language and source in one summary, by a model that adds up what it reads."""

    def adder(_: str, user: str) -> str:
        return str(sum(int(n) for n in user.split()))

    def ask(prompts):
        done = models.complete_prompts(prompts.withColumn("system", F.lit("")), "system", "text", [("adder", adder)])
        return done.drop("system")

    d = read(spark, sf, "documents").select("lang", "source", "doc_id", F.length("text").cast("string").alias("size"))
    done = reduce_texts(d, ["lang", "source"], ["doc_id"], "size", ask, limit=100)
    return done.select("lang", "source", F.col("summary").cast("long").alias("chars"), "failed")


def sum_event_names(spark, sf):
    named = S.number_events(replies(spark, sf), ["thread_id"], ["doc_id"])
    return named.select("thread_id", "doc_id", "event_id", "event_name")


def sum_structured(spark, sf):
    return S.structured_results(replies(spark, sf), ["thread_id"], ["doc_id"])


def sum_fallback(spark, sf):
    """Summaries by a provider that answers, gives blanks, or fails, by language."""

    def provider(system: str, user: str) -> str:
        if "lang en" in user:
            return "fine"
        if "lang fr" in user:
            return "  \n"
        raise ValueError("down")

    d = read(spark, sf, "documents")
    rows = d.select(
        "doc_id",
        F.concat(F.lit("lang "), F.col("lang")).alias("query"),
        F.lit("2024-01-01 00:00:00").alias("start_date"),
        F.lit("2024-01-30 00:00:00").alias("end_date"),
        F.expr("CASE WHEN source = 'src3' THEN '' ELSE text END").alias("combined_summary"),
        F.lit("").alias("combined_context"),
        F.col("source").alias("structured_results"),
        F.lit("{}").alias("event_map"),
    )
    done = S.final_summary(rows, [("stub", provider)], "sum up", "{query}: {results}")
    return done.select("doc_id", "summary")


def sum_run_queries(spark, sf):
    """Benchmark texts asked of all documents: retrieve, chunk, score, parse, sum up."""
    d = read(spark, sf, "documents")
    path = scratch_path(spark, "kb")
    table = models.embed_texts(d, "text", [("stub", stub_embed)]).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("thread_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("posted_date_time"),
        "text",
        "embedding",
    )
    build_if_absent(table, path)
    kb = spark.read.parquet(path)
    queries = read(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    stub = [("stub", stub_complete)]
    _, summaries = run_queries(kb, queries, Models([("stub", stub_embed)], stub), k=3)
    return summaries.select("query_id", "start_date", "end_date", "event_map", "summary")


QUERIES = {
    f.__name__: f
    for f in (
        llm_complete, llm_ledger, llm_render, llm_sections, llm_metric_rows, llm_metrics, llm_context,
        llm_sizes, sum_context_block, sum_combine, sum_event_names, sum_tree, sum_structured, sum_fallback,
        sum_run_queries,
    )
}

_S = lambda x: sql_strip(x)
_PARTS = f"""{REPLIES}, parts AS (
  SELECT doc_id, thread_id, reply, {_S("split_part(reply, '<signal_context>', 1)")} AS analysis,
         {_S("split_part(reply, '<signal_context>', 2)")} AS context,
         len(string_split(reply, '<signal_context>')) AS sections FROM replies)"""
_LINES = f"""{_PARTS}, lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(analysis, chr(10)) AS l FROM parts WHERE sections > 1)),
fields AS (SELECT doc_id, pos, list_transform(string_split(
    regexp_extract(line, '^[^()]*\\(([^)]*)\\)', 1), ','), lambda s: {_S('s')}) AS f FROM lines),
metric_lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line,
    f[1] AS t, f[2] AS name, try_cast(f[3] AS DOUBLE) AS value, try_cast(f[4] AS DOUBLE) AS confidence
  FROM fields WHERE len(f) >= 4 AND try_cast(f[3] AS DOUBLE) IS NOT NULL),
last_metrics AS (SELECT doc_id, name, arg_max(value, line) AS value FROM metric_lines GROUP BY 1, 2)"""
_CONTEXT = f"""{_PARTS}, ctx AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS raw
  FROM (SELECT doc_id, string_split(context, chr(10)) AS l FROM parts WHERE sections > 1)),
heads AS (SELECT doc_id, pos, {_S('raw')} AS line, CASE
    WHEN contains(lower(raw), 'key claims') THEN 'key_claims'
    WHEN contains(lower(raw), 'supporting') AND contains(lower(raw), 'text') THEN 'supporting_text'
    WHEN contains(lower(raw), 'risk') AND contains(lower(raw), 'assessment') THEN 'risk_assessment'
    WHEN contains(lower(raw), 'viral') AND contains(lower(raw), 'potential') THEN 'viral_potential'
    END AS head FROM ctx),
items AS (SELECT doc_id, pos, section, {_S('substr(line, 2)')} AS item FROM (
    SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM heads)
  WHERE head IS NULL AND section IS NOT NULL AND (line LIKE '-%' OR line LIKE '*%')
    AND {_S('substr(line, 2)')} <> '')"""


def _list(name: str, sep: str, lead: str = "") -> str:
    return (
        f"coalesce(string_agg({lead}item, {sep} ORDER BY pos) FILTER (section = '{name}'), '')"
    )


_BLOCKS = ", ".join(
    f"'{head}' || chr(10) || string_agg('- ' || item, chr(10) ORDER BY pos) FILTER (section = '{name}')"
    for name, head in zip(
        NAMES, ["Key Claims:", "\nSupporting Evidence:", "\nRisk Assessment:", "\nViral Potential:"]
    )
)
_EVENTS = f"""{_PARTS}, named AS (SELECT doc_id, thread_id, replace(replace({_S('''split_part(
    ''' + _S('split_part(split_part(context, $$Key claims detected:$$, 2), chr(10), 1)') + ''', '.', 1)''')},
    chr(34), ''), chr(39), '') AS event_name
  FROM parts WHERE contains(context, 'Key claims detected:')),
events_ AS (SELECT *, 'event' || row_number() OVER (PARTITION BY thread_id ORDER BY doc_id) AS event_id FROM named)"""
_FALLBACK = (
    "'### 1. Temporal Overview\nTime Range: 2024-01-01 00:00:00 to 2024-01-30 00:00:00\n"
    "Active Periods: Multiple threads analyzed across the time range\n"
    "Thread Distribution: See detailed metrics below\n\n### 2. Thread Analysis\n'"
)

_NN = "chr(10) || chr(10)"
_CTX = f"'Key claims detected:' || chr(10) || '- {len(SYSTEM_PROMPT)} characters of system prompt'"
_BLOCK = f"'Key Claims:' || chr(10) || '- {len(SYSTEM_PROMPT)} characters of system prompt'"
_DAY = "2024-01-01 00:00:00"
_DATED = f"(SELECT doc_id, source AS thread_id, TIMESTAMP '{_DAY}' AS posted_date_time, text FROM documents)"
_TEXTS = f"SELECT doc_id, {clean_chunk_sql(framed_sql)} AS x FROM {_DATED} WHERE length({_S('text')}) >= 20"
_SUMMARY_PROMPT = (
    f"'Question: ' || query || {_NN} || 'Time Range: {_DAY} to {_DAY}' || {_NN} || 'Context:' || chr(10) "
    f"|| cc || {_NN} || '<event_mapping>' || chr(10) || em || chr(10) || '</event_mapping>' || {_NN} "
    f"|| 'Analyses:' || chr(10) || sr || {_NN} || 'Write one summary for the time from {_DAY} to {_DAY}.'"
)
_RUN = f"""WITH RECURSIVE
  emb AS (SELECT doc_id, source, {sql_embed('text')}::DOUBLE[] AS v FROM documents),
  q AS (SELECT item_id AS query_id, text AS query, {sql_embed('text')}::DOUBLE[] AS v FROM benchmark),
  pairs AS (SELECT query_id, doc_id AS vec_id, source AS label, list_cosine_similarity(emb.v, q.v) AS s
            FROM emb, q),
  {threads_sql(3, 'query_id', 'pairs')},
  {packed_sql(_TEXTS, '', 1000)},
  valid AS (SELECT * FROM packed WHERE {VALID_SQL}),
  replies_ AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, seq) AS n,
      '(t, prompt_length, ' || ({len(CHUNK_PROMPT) - len('{content}')} + length(text)) || ', 0.9)' AS analysis
    FROM ranked JOIN valid ON vec_id = doc_id WHERE rank <= 3),
  joined AS (SELECT query_id, string_agg({_BLOCK}, {_NN}) AS cc,
      string_agg('<analysis_section>' || chr(10) || analysis || chr(10) || {_CTX} || chr(10)
        || '</analysis_section>', {_NN} ORDER BY n) AS sr,
      '{{' || string_agg('"event' || n || '":""', ',' ORDER BY n) || '}}' AS em
    FROM replies_ GROUP BY query_id)
SELECT query_id, CASE WHEN sr IS NOT NULL THEN '{_DAY}' END AS start_date,
       CASE WHEN sr IS NOT NULL THEN '{_DAY}' END AS end_date, coalesce(em, '{{}}') AS event_map,
       CASE WHEN sr IS NULL THEN '' ELSE '(t, prompt_length, ' || length({_SUMMARY_PROMPT}) || ', 0.9)' || chr(10)
         || '<signal_context>' || chr(10) || 'Key claims detected:' || chr(10)
         || '- {len(SUMMARY_SYSTEM_PROMPT)} characters of system prompt' END AS summary
FROM q LEFT JOIN joined USING (query_id)"""

ORACLES = {
    "llm_complete": """SELECT doc_id, CASE WHEN lang <> 'de' THEN '(t, prompt_length, '
          || (length(text) + length(lang) + 1) || ', 0.9)' || chr(10) || '<signal_context>' || chr(10)
          || 'Key claims detected:' || chr(10) || '- 8 characters of system prompt' END AS reply,
        CASE WHEN lang <> 'de' THEN 'stub' END AS model,
        CASE WHEN lang = 'de' THEN 'ValueError: no German' END AS error FROM documents""",
    "llm_ledger": """SELECT doc_id, CASE WHEN lang <> 'de' THEN '(t, prompt_length, '
          || (length(text) + length(lang) + 1) || ', 0.9)' || chr(10) || '<signal_context>' || chr(10)
          || 'Key claims detected:' || chr(10) || '- 8 characters of system prompt' END AS reply,
        CASE WHEN lang <> 'de' THEN 'stub' END AS model,
        CASE WHEN lang = 'de' THEN 'ValueError: no German' END AS error,
        CAST(1 AS BIGINT) AS entries FROM documents""",
    "llm_render": """SELECT doc_id, 'Q {content}' || source || ' in ' || lang || ': ' || text
        || ' / {content}' || source || ' {unknown}' AS prompt FROM documents""",
    "llm_sections": f"""WITH {_PARTS} SELECT doc_id, analysis, context, CAST(sections AS INT) AS sections
        FROM parts""",
    "llm_metric_rows": f"""WITH {_LINES} SELECT doc_id, CAST(line AS INT) AS line, t, name, value, confidence
        FROM metric_lines""",
    "llm_metrics": f"WITH {_LINES} SELECT doc_id, name, value FROM last_metrics",
    "llm_context": f"""WITH {_CONTEXT}, lists AS (SELECT doc_id, {', '.join(
            f"{_list(n, "' | '")} AS {n}" for n in NAMES)} FROM items GROUP BY doc_id)
        SELECT doc_id, {', '.join(f"coalesce({n}, '') AS {n}" for n in NAMES)}
        FROM documents LEFT JOIN lists USING (doc_id)""",
    "llm_sizes": f"""WITH {_LINES} SELECT doc_id, 'sections' AS name, CAST(sections AS DOUBLE) AS value FROM parts
        UNION ALL SELECT doc_id, 'analysis_length',
          CAST(CASE WHEN sections > 1 THEN length(analysis) ELSE length(reply) END AS DOUBLE) FROM parts
        UNION ALL SELECT doc_id, 'context_length', CAST(length(context) AS DOUBLE) FROM parts
        UNION ALL SELECT doc_id, name, value FROM last_metrics""",
    "sum_context_block": f"""WITH {_CONTEXT}, blocks AS (
          SELECT doc_id, concat_ws(chr(10), {_BLOCKS}) AS block FROM items GROUP BY doc_id)
        SELECT doc_id, coalesce(block, '') AS block FROM documents LEFT JOIN blocks USING (doc_id)""",
    "sum_combine": f"""SELECT conv_id, string_agg({_S('text')}, chr(10) || chr(10) ORDER BY turn)
        FILTER ({_S('text')} <> '') AS combined FROM conversations GROUP BY conv_id""",
    "sum_tree": """SELECT lang, source, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS failed
        FROM documents GROUP BY lang, source""",
    "sum_event_names": f"WITH {_EVENTS} SELECT thread_id, doc_id, event_id, event_name FROM events_",
    "sum_structured": f"""WITH {_EVENTS}, sections_ AS (SELECT thread_id, coalesce(string_agg(
          '<analysis_section>' || chr(10) || analysis || chr(10) || context || chr(10) || '</analysis_section>',
          chr(10) || chr(10) ORDER BY doc_id) FILTER (sections > 1), '') AS structured_results
          FROM parts GROUP BY thread_id),
        maps AS (SELECT thread_id, '{{' || string_agg('"' || event_id || '":' || to_json(event_name)::VARCHAR, ','
          ORDER BY doc_id) || '}}' AS event_map FROM events_ GROUP BY thread_id)
        SELECT thread_id, structured_results, coalesce(event_map, '{{}}') AS event_map
        FROM sections_ LEFT JOIN maps USING (thread_id)""",
    "sum_fallback": f"""SELECT doc_id, CASE WHEN source = 'src3' THEN '' WHEN lang = 'en' THEN 'fine'
        WHEN lang = 'fr' THEN {_FALLBACK} || source
        ELSE {_FALLBACK} || text END AS summary FROM documents""",
    "sum_run_queries": _RUN,
}

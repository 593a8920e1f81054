"""Scores, alerts, thread dynamics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import CITED, POSTS, STEPS, cited_posts, ntz, posts, read, steps
from threadloom import schemas
from threadloom.operators import metrics as M
from threadloom.operators import similarity, threads as T
from threadloom.session import scratch_path
from threadloom.sources import writers
from threadloom.streaming import alerts, ingest


def _tags(df):
    return df.withColumn("tags", F.array_join("tags", ","))


def _scores(spark, sf):
    s = steps(spark, sf)
    about = M.metadata_comment(step=F.col("step"), provider=F.col("provider"))
    wide = s.withColumns(
        {"error_rate": F.col("failed").cast("int"), "success_rate": 1 - F.col("failed").cast("int")}
    )
    return M.score_rows(
        wide, ["duration", "error_rate", "success_rate", "props"], comment=about, keep=["run_id"]
    )


def mon_scores(spark, sf):
    return _tags(_scores(spark, sf))


def mon_map_scores(spark, sf):
    """Metrics of a step held as a map, and a boolean among its columns."""
    s = steps(spark, sf)
    numbers = F.create_map(
        F.lit("duration"), F.col("duration"), F.lit("user"), F.col("run_id").cast("double"),
        F.lit("none"), F.lit(None).cast("double"),
    )
    held = M.map_score_rows(s.withColumn("metrics", numbers), "metrics", tags=("map",))
    flags = M.score_rows(s, ["failed"], tags=("flag",))
    return _tags(held.unionByName(flags)).drop("comment")


def mon_step_rollup(spark, sf):
    r = M.step_rollup(steps(spark, sf))
    rounded = ["avg_duration", "success_rate", "error_rate"]
    return r.withColumns({c: F.round(c, 6) for c in rounded})


def mon_relevance(spark, sf):
    """Similarity to the first vector as relevance, missing for rows without one."""
    v = read(spark, sf, "embeddings")
    query = v.filter("vec_id = 0").select("embedding").first()[0]
    scored = similarity.score(v, query).select(
        F.col("vec_id").alias("doc_id"), F.col("similarity").alias("relevance_score")
    )
    chunks = read(spark, sf, "documents").join(scored, "doc_id", "left")
    r = M.mean_relevance(chunks, ["lang"])
    return r.withColumns({c: F.round(c, 6) for c in ("average_relevance", "confidence_score")})


def mon_error_rate(spark, sf):
    r = M.error_rate(steps(spark, sf), ["run_id"])
    return r.withColumn("error_rate", F.round("error_rate", 6))


def mon_alerts(spark, sf):
    return _tags(M.evaluate_rules(_scores(spark, sf)))


def mon_lifecycle(spark, sf):
    s = steps(spark, sf).withColumn("status", F.concat(F.lit("running_"), F.col("step_id")))
    r = M.run_lifecycle(s)
    return r.withColumns({c: ntz(c) for c in ("start_time", "end_time")})


def mon_start_runs(spark, sf):
    d = read(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"), F.col("text").alias("query")
    )
    return M.start_runs(d)


def mon_lengths(spark, sf):
    p = posts(spark, sf).withColumn("step_id", F.expr("CASE WHEN lang <> 'de' THEN CAST(doc_id AS STRING) END"))
    return _tags(M.length_scores(p, input="text", output="filename")).drop("comment")


def mon_experiments(spark, sf):
    s = _scores(spark, sf).withColumn("step", F.lit("x"))
    model = M.model_scores(s, F.lit("model_a"))
    analysis = M.analysis_scores(s, F.lit("thread"))
    return _tags(model.unionByName(analysis).drop("step"))


def mon_run_bundle(spark, sf):
    p = posts(spark, sf).select(
        F.col("doc_id").cast("string").alias("step_id"),
        F.col("text").alias("query"),
        F.expr("CASE WHEN lang = 'en' THEN filename END").alias("summary"),
        F.col("doc_id").alias("chunks_generated"),
        F.lit("complete").alias("stage"),
    )
    rows = M.run_bundle(p, {"chunker": ["chunks_generated"]}, ["chunks_generated", "stage"])
    return _tags(rows)


def mon_feedback(spark, sf):
    rated = read(spark, sf, "labels").join(read(spark, sf, "documents"), "doc_id").select(
        F.col("source").alias("step_id"), F.col("quality").alias("feedback"), F.col("lang").alias("note")
    )
    r = M.feedback_rollup(M.feedback_scores(rated, "feedback", "note"))
    return r.withColumn("avg_feedback", F.round("avg_feedback", 6))


def _errors(spark, sf):
    return steps(spark, sf).filter("failed").select(
        "step_id", F.concat(F.lit("E"), F.expr("CAST(run_id AS INT) % 5")).alias("error_type"),
        F.concat(F.lit("message "), F.col("step_id")).alias("message"),
        F.lit(None).cast("string").alias("trace"), "ts",
    )


def mon_error_scores(spark, sf):
    return _tags(M.error_scores(_errors(spark, sf), "error_type", "message", "trace"))


def mon_error_groups(spark, sf):
    r = M.error_groups(_errors(spark, sf), "error_type", "message", "ts")
    return r.withColumn("last_seen", ntz("last_seen"))


def _completions(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("step_id"), F.col("role").alias("prompt_id"),
        F.col("text").alias("completion"), (F.col("turn") * 1.5).alias("duration"),
    )


def mon_prompt_scores(spark, sf):
    return _tags(M.prompt_scores(_completions(spark, sf), "completion")).drop("comment")


def mon_prompt_usage(spark, sf):
    r = M.prompt_usage(_completions(spark, sf), "prompt_id", "completion", "duration")
    return r.withColumn("avg_duration", F.round("avg_duration", 6))


def _event_posts(spark, sf):
    return read(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("thread_id"), F.col("ts").alias("posted_date_time"),
        F.col("props").alias("text"), "event_type",
    )


def thr_activity(spark, sf):
    r = T.activity(posts(spark, sf))
    return r.withColumn("chars_per_minute", F.round("chars_per_minute", 6))


def thr_lifetime(spark, sf):
    return T.lifetime(_event_posts(spark, sf))


def thr_reply_gaps(spark, sf):
    gaps = T.reply_gaps(_event_posts(spark, sf), "event_id")
    return gaps.select("event_id", "thread_id", F.round("gap_seconds", 6).alias("gap_seconds"))


def thr_frequency(spark, sf):
    r = T.hourly_frequency(_event_posts(spark, sf))
    return r.withColumns({"hour": ntz("hour"), "mean_posts": F.round("mean_posts", 6)})


def thr_reach(spark, sf):
    return T.reach(cited_posts(spark, sf))


def thr_impact(spark, sf):
    return T.impact(cited_posts(spark, sf))


def thr_lookbacks(spark, sf):
    return T.lookbacks(_event_posts(spark, sf), "posted_date_time", "event_type")


RAW = schemas.RAW_POSTS.fieldNames()


def str_ingest(spark, sf):
    """Two drops of files, of two column orders, and two runs: each file is taken once."""
    source, target, mark = (scratch_path(spark, n) for n in ("drop", "taken", "mark"))
    raw = posts(spark, sf).select(
        "thread_id", F.date_format("posted_date_time", "yyyy-MM-dd HH:mm:ss").alias("posted_date_time"),
        F.col("text").alias("text_clean"), "filename", "lang",
    )
    for condition, order in (("lang = 'en'", RAW), ("lang <> 'en'", ["lang", *reversed(RAW)])):
        writers.write_csv(raw.filter(condition).select(*order), f"{source}/{len(condition)}")
        files = ingest.stream_files(spark, source, "2000-01-01 00:00:00", "part-")
        ingest.ingest_available(files, target, mark).awaitTermination()
    return spark.read.parquet(target).drop("batch")


def _step_stream(spark, sf):
    path = scratch_path(spark, "steps")
    table = steps(spark, sf)
    writers.replace_table(table, path)
    return spark.readStream.schema(table.schema).parquet(path)


def str_alerts(spark, sf):
    path, target, mark = (scratch_path(spark, n) for n in ("scores", "alerts", "mark"))
    table = _scores(spark, sf)
    writers.replace_table(table, path)
    stream = alerts.alert_stream(spark.readStream.schema(table.schema).parquet(path))
    alerts.run_available(stream, target, mark).awaitTermination()
    return _tags(spark.read.parquet(target))


def str_error_rate(spark, sf):
    """Windows the watermark has closed."""
    target, mark = scratch_path(spark, "rates"), scratch_path(spark, "mark")
    stream = alerts.windowed_error_rate(_step_stream(spark, sf))
    alerts.run_available(stream, target, mark).awaitTermination()
    done = spark.read.parquet(target)
    return done.select(
        ntz("window_start").alias("window_start"), ntz("window_end").alias("window_end"),
        "total_operations", "failed_operations", F.round("error_rate", 6).alias("error_rate"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        mon_scores, mon_map_scores, mon_step_rollup, mon_relevance, mon_error_rate, mon_alerts, mon_lifecycle,
        mon_start_runs, mon_lengths, mon_experiments, mon_run_bundle, mon_feedback,
        mon_error_scores, mon_error_groups, mon_prompt_scores, mon_prompt_usage, thr_activity,
        thr_lifetime, thr_reply_gaps, thr_frequency, thr_reach, thr_impact, thr_lookbacks,
        str_ingest, str_alerts, str_error_rate,
    )
}

_SCORES = f"""{STEPS}, scores AS (
  SELECT run_id, step_id, u.name, 'AI' AS type, u.value,
         'step: ' || step || ', provider: ' || provider AS comment, 'metric' AS tags
  FROM steps, LATERAL (VALUES ('duration', duration), ('error_rate', CAST(failed AS INT)::DOUBLE),
    ('success_rate', 1 - CAST(failed AS INT)::DOUBLE)) u(name, value))"""
_ALERTS = f"""WITH {_SCORES}, rules(metric, op, threshold, alert, comment, tags) AS (VALUES
    ('duration', '>', 5.0, 'alert_slow_operation', 'Operation exceeded duration threshold of 5.0 seconds', 'alert,performance'),
    ('error_rate', '>', 0.1, 'alert_high_error_rate', 'Error rate exceeded threshold of 10%', 'alert,reliability'),
    ('success_rate', '<', 0.9, 'alert_low_success', 'Success rate below threshold of 90%', 'alert,reliability'))
  SELECT run_id, step_id, alert AS name, 'AI' AS type, 0.0::DOUBLE AS value, r.comment, r.tags, metric,
         s.value AS metric_value
  FROM scores s JOIN rules r ON s.name = r.metric
  WHERE (op = '>' AND value > threshold) OR (op = '<' AND value < threshold)"""
_TITLE = "CASE name WHEN 'duration' THEN 'Duration' WHEN 'error_rate' THEN 'Error Rate' ELSE 'Success Rate' END"
_ERRORS = f"""{STEPS}, errors AS (SELECT step_id, 'E' || (CAST(run_id AS INT) % 5) AS error_type,
  'message ' || step_id AS message, ts FROM steps WHERE failed)"""
_COMPLETIONS = """completions AS (SELECT conv_id || '-' || turn AS step_id, role AS prompt_id,
  text AS completion, CAST(turn * 1.5 AS DOUBLE) AS duration FROM conversations)"""
_POST_LENGTHS = f"""{POSTS}, kept AS (SELECT CAST(doc_id AS VARCHAR) AS step_id, text, filename
  FROM posts WHERE lang <> 'de')"""
_BUNDLE = "SELECT step_id, {name} AS name, 'AI' AS type, {value} AS value, {comment} AS comment, 'metric' AS tags FROM bundle"
_LENGTH_NOTE = (
    "'experiment_type: knowledge_run, has_query: True, has_summary: ' || "
    "CASE WHEN summary IS NULL THEN 'False' ELSE 'True' END"
)
_SECONDS = "(epoch_us({b}) - epoch_us({a})) / 1e6"
_LOOKBACK = ", ".join(
    f"count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL {h} HOUR) AS posts_{n}"
    for n, h in (("24h", 24), ("72h", 72), ("7d", 168), ("30d", 720))
)
_REFS = f"""{CITED}, refs AS (SELECT thread_id,
  unnest(list_transform(regexp_extract_all(text, '>>\\d+'), lambda s: substr(s, 3))) AS ref FROM cited)"""

ORACLES = {
    "mon_scores": f"WITH {_SCORES} SELECT * FROM scores",
    "mon_map_scores": f"""WITH {STEPS}
        SELECT step_id, u.name, 'AI' AS type, u.value, u.tags FROM steps, LATERAL (VALUES
          ('duration', duration, 'map'), ('user', CAST(run_id AS DOUBLE), 'map'),
          ('failed', CAST(failed AS INT)::DOUBLE, 'flag')) u(name, value, tags)
        WHERE u.value IS NOT NULL""",
    "mon_step_rollup": f"""WITH {STEPS} SELECT step, provider, count(*) AS steps,
        round(avg(duration), 6) AS avg_duration, max(duration) AS max_duration,
        round(avg(1 - CAST(failed AS INT)), 6) AS success_rate,
        round(avg(CAST(failed AS INT)), 6) AS error_rate FROM steps GROUP BY ALL""",
    "mon_relevance": """WITH scored AS (SELECT e.vec_id AS doc_id, round(list_cosine_similarity(
          e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s
          FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
        SELECT lang, count(*)::DOUBLE AS chunks_generated, round(avg(coalesce(s, 0)), 6) AS average_relevance,
               round(avg(coalesce(s, 0)), 6) AS confidence_score
        FROM documents LEFT JOIN scored USING (doc_id) GROUP BY lang""",
    "mon_error_rate": f"""WITH {STEPS} SELECT run_id, count(*) AS total_operations,
        CAST(sum(CAST(failed AS INT)) AS BIGINT) AS failed_operations,
        round(avg(CAST(failed AS INT)), 6) AS error_rate FROM steps GROUP BY run_id""",
    "mon_alerts": _ALERTS,
    "mon_lifecycle": f"""WITH {STEPS} SELECT run_id, min(ts) AS start_time, max(ts) AS end_time,
        'running_' || arg_max(step_id, ts) AS status, count(*) AS events,
        {_SECONDS.format(a='min(ts)', b='max(ts)')} AS duration FROM steps GROUP BY run_id""",
    "mon_start_runs": """SELECT doc_id AS run_id, text AS query,
        CAST(length(text) AS INT) AS query_length, 'started' AS status FROM documents""",
    "mon_lengths": f"""WITH {_POST_LENGTHS}
        SELECT step_id, 'input_length' AS name, 'AI' AS type, length(text)::DOUBLE AS value, 'input,length' AS tags FROM kept
        UNION ALL SELECT step_id, 'output_length', 'AI', length(filename)::DOUBLE, 'output,length' FROM kept""",
    "mon_experiments": f"""WITH {_SCORES}
        SELECT run_id, step_id, 'experiment_model_a_metrics_' || name AS name, type, value,
          {_TITLE} || ' for model_a' AS comment,
          'experiment,model_a_metrics,model,model_a,' || name AS tags FROM scores
        UNION ALL SELECT run_id, step_id, 'experiment_thread_analysis_' || name, type, value,
          {_TITLE} || ' for thread', 'experiment,thread_analysis,analysis,thread,' || name FROM scores""",
    "mon_run_bundle": f"""WITH {POSTS}, bundle AS (SELECT CAST(doc_id AS VARCHAR) AS step_id, text AS query,
          CASE WHEN lang = 'en' THEN filename END AS summary, doc_id FROM posts)
        {_BUNDLE.format(name="'query_length'", value='length(query)::DOUBLE', comment=_LENGTH_NOTE)}
        UNION ALL {_BUNDLE.format(name="'summary_length'", value="length(coalesce(summary, ''))::DOUBLE", comment=_LENGTH_NOTE)}
        UNION ALL {_BUNDLE.format(name="'chunks_generated'", value='doc_id::DOUBLE', comment="'model: chunker'")}
        UNION ALL {_BUNDLE.format(name="'chunks_generated'", value='doc_id::DOUBLE', comment="'metric_type: analysis'")}""",
    "mon_feedback": """SELECT source AS step_id, round(avg(quality), 6) AS avg_feedback,
        count(quality) AS ratings FROM labels JOIN documents USING (doc_id) GROUP BY source""",
    "mon_error_scores": f"""WITH {_ERRORS} SELECT step_id, 'error_details' AS name, 'AI' AS type,
        1.0::DOUBLE AS value, 'Error Type: ' || error_type || chr(10) || 'Error Message: ' || message
          || chr(10) || 'Stack Trace:' || chr(10) AS comment, 'error,' || error_type AS tags FROM errors""",
    "mon_error_groups": f"""WITH {_ERRORS} SELECT error_type, count(*) AS errors,
        arg_max(message, ts) AS last_message, max(ts) AS last_seen FROM errors GROUP BY error_type""",
    "mon_prompt_scores": f"""WITH {_COMPLETIONS}
        SELECT step_id, 'prompt_tokens' AS name, 'AI' AS type, (length(completion) // 4)::DOUBLE AS value,
               'prompt,generation' AS tags FROM completions
        UNION ALL SELECT step_id, 'prompt_duration', 'AI', duration, 'prompt,generation' FROM completions""",
    "mon_prompt_usage": f"""WITH {_COMPLETIONS} SELECT prompt_id, count(*) AS calls,
        CAST(sum(length(completion) // 4) AS BIGINT) AS tokens, round(avg(duration), 6) AS avg_duration,
        max(duration) AS max_duration FROM completions GROUP BY prompt_id""",
    "thr_activity": f"""WITH {POSTS} SELECT thread_id, count(*) AS posts,
        CAST(sum(length(text)) AS BIGINT) AS chars,
        round(sum(length(text)) / nullif({_SECONDS.format(a='min(posted_date_time)', b='max(posted_date_time)')} / 60, 0), 6)
          AS chars_per_minute FROM posts GROUP BY thread_id""",
    "thr_lifetime": f"""SELECT user_id AS thread_id, min(ts) AS first_post, max(ts) AS last_post,
        {_SECONDS.format(a='min(ts)', b='max(ts)')} AS lifetime_seconds FROM events GROUP BY user_id""",
    "thr_reply_gaps": f"""SELECT event_id, user_id AS thread_id, round({_SECONDS.format(
          a='lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)', b='ts')}, 6) AS gap_seconds
        FROM events""",
    "thr_frequency": """WITH h AS (SELECT user_id AS thread_id, date_trunc('hour', ts) AS hour, count(*) AS posts
          FROM events GROUP BY ALL),
        m AS (SELECT *, avg(posts) OVER (PARTITION BY thread_id) AS mean FROM h)
        SELECT thread_id, hour, posts, round(mean, 6) AS mean_posts, posts >= 2 * mean AS burst FROM m""",
    "thr_reach": f"WITH {_REFS} SELECT thread_id, count(DISTINCT ref) AS reach FROM refs GROUP BY thread_id",
    "thr_impact": f"""WITH {_REFS}, cited_by AS (SELECT ref, count(DISTINCT thread_id) AS impact FROM refs
          WHERE ref <> thread_id GROUP BY ref)
        SELECT thread_id, coalesce(impact, 0) AS impact FROM (SELECT DISTINCT thread_id FROM posts)
        LEFT JOIN cited_by ON ref = thread_id""",
    "thr_lookbacks": f"SELECT event_type, {_LOOKBACK} FROM events GROUP BY event_type",
    "str_ingest": f"""WITH {POSTS} SELECT thread_id, strftime(posted_date_time, '%Y-%m-%d %H:%M:%S')
        AS posted_date_time, text AS text_clean, filename FROM posts""",
    "str_alerts": _ALERTS,
    "str_error_rate": f"""WITH {STEPS}, w AS (SELECT date_trunc('hour', ts) AS window_start,
          count(*) AS total_operations, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS failed_operations
          FROM steps GROUP BY 1)
        SELECT CAST(window_start AS TIMESTAMP) AS window_start,
          CAST(window_start + INTERVAL 1 HOUR AS TIMESTAMP) AS window_end, total_operations,
          failed_operations, round(failed_operations / total_operations, 6) AS error_rate
        FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
}

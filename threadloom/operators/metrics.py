"""Scores, runs and alerts.

``scores`` is an append-only table (run_id, step_id, name, type, value,
comment, tags, ts). ``steps`` are step events, one row per finished step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import schemas

#: booleans count as 0 and 1
NUMERIC = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DecimalType,
)

# The default alert rules.
DEFAULT_RULES = [
    ("duration", ">", 5.0, "alert_slow_operation",
     "Operation exceeded duration threshold of 5.0 seconds", ["alert", "performance"]),
    ("error_rate", ">", 0.1, "alert_high_error_rate",
     "Error rate exceeded threshold of 10%", ["alert", "reliability"]),
    ("confidence_score", "<", 0.7, "alert_low_confidence",
     "Confidence score below threshold of 70%", ["alert", "quality"]),
    ("success_rate", "<", 0.9, "alert_low_success",
     "Success rate below threshold of 90%", ["alert", "reliability"]),
    ("average_relevance", "<", 0.6, "alert_low_relevance",
     "Average relevance score below threshold of 0.6", ["alert", "quality"]),
]


def metadata_comment(**metadata: Column) -> Column:
    """``k: v, k: v`` of the given columns, nulls left out."""
    return F.concat_ws(
        ", ", *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in metadata.items()]
    )


def score_rows(
    df: DataFrame,
    metrics: Sequence[str],
    step_col: str = "step_id",
    comment: Column | None = None,
    tags: Sequence[str] = ("metric",),
    kind: str = "AI",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Wide metrics to score rows; non-numeric columns and rows without a step go."""
    numeric = [m for m in metrics if isinstance(df.schema[m].dataType, NUMERIC)]
    pairs = F.array(
        *[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in numeric]
    )
    note = F.lit(None).cast("string") if comment is None else comment
    return (
        df.filter(F.col(step_col).isNotNull())
        .select(
            *keep,
            F.col(step_col).alias("step_id"),
            F.lit(kind).alias("type"),
            note.alias("comment"),
            F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
            F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("_m"),
        )
        .select(*keep, "step_id", "_m.name", "type", "_m.value", "comment", "tags")
    )


def map_score_rows(
    df: DataFrame,
    metrics_col: str,
    step_col: str = "step_id",
    comment: Column | None = None,
    tags: Sequence[str] = ("metric",),
) -> DataFrame:
    """The same for metrics held as a map of name to number or boolean."""
    note = F.lit(None).cast("string") if comment is None else comment
    return (
        df.filter(F.col(step_col).isNotNull())
        .select(
            F.col(step_col).alias("step_id"),
            F.lit("AI").alias("type"),
            note.alias("comment"),
            F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
            F.explode(metrics_col).alias("name", "value"),
        )
        .filter(F.col("value").isNotNull())
        .select("step_id", "name", "type", F.col("value").cast("double"), "comment", "tags")
    )


def step_rollup(
    steps: DataFrame, by: Sequence[str] = ("step", "provider"),
    duration_col: str = "duration", failed_col: str = "failed",
) -> DataFrame:
    """Steps, mean and longest duration, success and error rate per group."""
    failed = F.col(failed_col).cast("int")
    return steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"),
        F.avg(duration_col).alias("avg_duration"),
        F.max(duration_col).alias("max_duration"),
        F.avg(1 - failed).alias("success_rate"),
        F.avg(failed).alias("error_rate"),
    )


def mean_relevance(chunks: DataFrame, by: Sequence[str], relevance_col: str = "relevance_score") -> DataFrame:
    """Mean relevance per group, a missing one counting as 0, and the same as confidence."""
    mean = F.avg(F.coalesce(F.col(relevance_col).cast("double"), F.lit(0.0)))
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("chunks_generated"),
        mean.alias("average_relevance"),
        mean.alias("confidence_score"),
    )


def error_rate(df: DataFrame, by: Sequence[str] = (), failed_col: str = "failed") -> DataFrame:
    """Failed over total operations, 0 where there are none."""
    failed = F.coalesce(F.sum(F.col(failed_col).cast("int")), F.lit(0))
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        total.alias("total_operations"),
        failed.alias("failed_operations"),
        F.coalesce(F.try_divide(failed, total), F.lit(0.0)).alias("error_rate"),
    )


def rules_table(spark: SparkSession, rules: Sequence[tuple] = tuple(DEFAULT_RULES)) -> DataFrame:
    return spark.createDataFrame(list(rules), schemas.RULES)


def evaluate_rules(scores: DataFrame, rules: Sequence[tuple] = tuple(DEFAULT_RULES)) -> DataFrame:
    """One alert row per score that breaks a rule.

    Rules are a list in the program, so their table is as small as the program;
    scores of metrics without a rule never leave the scan.
    """
    table = rules_table(scores.sparkSession, rules).select(
        F.col("metric").alias("_metric"),
        "op",
        "threshold",
        "alert_name",
        F.col("comment").alias("_comment"),
        F.col("tags").alias("_tags"),
    )
    value, limit = F.col("value"), F.col("threshold")
    broken = (
        F.when(F.col("op") == ">", value > limit)
        .when(F.col("op") == ">=", value >= limit)
        .when(F.col("op") == "<", value < limit)
        .when(F.col("op") == "<=", value <= limit)
        .when(F.col("op") == "=", value == limit)
    )
    measured = scores.filter(F.col("name").isin([r[0] for r in rules]))
    joined = measured.join(F.broadcast(table), measured["name"] == table["_metric"])
    rest = [c for c in scores.columns if c not in ("name", "type", "value", "comment", "tags")]
    return joined.filter(broken).select(
        *rest,
        F.col("alert_name").alias("name"),
        F.lit("AI").alias("type"),
        F.lit(0.0).alias("value"),
        F.col("_comment").alias("comment"),
        F.col("_tags").alias("tags"),
        F.col("_metric").alias("metric"),
        F.col("value").alias("metric_value"),
    )


def run_lifecycle(
    events: DataFrame, run_col: str = "run_id", status_col: str = "status", ts_col: str = "ts"
) -> DataFrame:
    """Start, end, duration in seconds and last status of each run.

    Of events at the same instant, a start comes first, then the order of names.
    """
    start, end = F.min(ts_col), F.max(ts_col)
    return events.groupBy(run_col).agg(
        start.alias("start_time"),
        end.alias("end_time"),
        (
            F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
        ).alias("_micros"),
        F.max_by(status_col, F.struct(F.col(ts_col), F.col(status_col) != "started", F.col(status_col))).alias("status"),
        F.count(F.lit(1)).alias("events"),
    ).withColumn("duration", F.col("_micros") / 1e6).drop("_micros")


def start_runs(
    df: DataFrame, run_col: str = "run_id", query_col: str = "query", length: int | None = None
) -> DataFrame:
    """Start row of each run: its status, and its query, cut if a length is given, with its length."""
    query = F.col(query_col) if length is None else F.substring(query_col, 1, length)
    return df.withColumns(
        {
            "query_length": F.length(query_col),
            query_col: query,
            "status": F.lit("started"),
        }
    )


def length_scores(df: DataFrame, step_col: str = "step_id", **texts: str) -> DataFrame:
    """Score rows ``{kind}_length`` for each ``kind=text column``."""
    parts = None
    for kind, column in texts.items():
        name = f"{kind}_length"
        one = df.filter(F.col(column).isNotNull()).select(
            F.col(step_col), F.length(column).cast("double").alias(name)
        )
        rows = score_rows(one, [name], step_col, tags=(kind, "length"))
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        raise ValueError("no text column given")
    return parts


def experiment_scores(scores: DataFrame, experiment: Column) -> DataFrame:
    """Scores renamed and tagged as those of an experiment."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return scores.filter(F.col("value").isNotNull() & F.col("step_id").isNotNull()).withColumns(
        {
            "name": F.concat(F.lit("experiment_"), experiment, F.lit("_"), F.col("name")),
            "comment": F.coalesce(F.col("comment"), F.lit("")),
            "tags": F.concat(F.array(F.lit("experiment"), experiment), tags),
        }
    )


def _titled(name: Column, owner: Column) -> Column:
    return F.concat(F.initcap(F.translate(name, "_", " ")), F.lit(" for "), owner)


def model_scores(scores: DataFrame, model: Column) -> DataFrame:
    """Scores of a model, as the experiment ``{model}_metrics``."""
    own = scores.withColumns(
        {
            "comment": _titled(F.col("name"), model),
            "tags": F.array(F.lit("model"), model, F.col("name")),
        }
    )
    return experiment_scores(own, F.concat(model, F.lit("_metrics")))


def analysis_scores(scores: DataFrame, analysis: Column) -> DataFrame:
    """Scores of an analysis, as the experiment ``{analysis}_analysis``."""
    own = scores.withColumns(
        {
            "comment": _titled(F.col("name"), analysis),
            "tags": F.array(F.lit("analysis"), analysis, F.col("name")),
        }
    )
    return experiment_scores(own, F.concat(analysis, F.lit("_analysis")))


def run_bundle(
    runs: DataFrame,
    model_metrics: dict[str, Sequence[str]],
    analysis_metrics: Sequence[str],
    step_col: str = "step_id",
    query_col: str = "query",
    summary_col: str = "summary",
    experiment_type: str = "knowledge_run",
) -> DataFrame:
    """All scores of a finished run: text lengths, per model, per analysis."""
    query = F.coalesce(F.col(query_col), F.lit(""))
    summary = F.coalesce(F.col(summary_col), F.lit(""))
    named = runs.withColumns(
        {"query_length": F.length(query), "summary_length": F.length(summary)}
    )
    flag = lambda c: F.when(c != "", F.lit("True")).otherwise(F.lit("False"))
    about = metadata_comment(
        experiment_type=F.lit(experiment_type),
        has_query=flag(query),
        has_summary=flag(summary),
    )
    rows = score_rows(named, ["query_length", "summary_length"], step_col, about)
    for model, metrics in model_metrics.items():
        own = metadata_comment(model=F.lit(model))
        rows = rows.unionByName(score_rows(named, metrics, step_col, own))
    kind = metadata_comment(metric_type=F.lit("analysis"))
    return rows.unionByName(score_rows(named, analysis_metrics, step_col, kind))


def feedback_scores(df: DataFrame, feedback_col: str, comment_col: str, step_col: str = "step_id") -> DataFrame:
    """Ratings by people as scores."""
    named = df.withColumnRenamed(feedback_col, "user-feedback")
    return score_rows(
        named, ["user-feedback"], step_col, F.col(comment_col), ("feedback",), "HUMAN"
    )


def feedback_rollup(scores: DataFrame, by: Sequence[str] = ("step_id",)) -> DataFrame:
    human = scores.filter((F.col("type") == "HUMAN") & (F.col("name") == "user-feedback"))
    return human.groupBy(*by).agg(
        F.avg("value").alias("avg_feedback"), F.count(F.lit(1)).alias("ratings")
    )


def error_scores(
    df: DataFrame, type_col: str, message_col: str, trace_col: str, step_col: str = "step_id"
) -> DataFrame:
    """Failures as ``error_details`` scores, tagged with their type."""
    text = F.format_string(
        "Error Type: %s\nError Message: %s\nStack Trace:\n%s",
        F.col(type_col), F.col(message_col), F.coalesce(F.col(trace_col), F.lit("")),
    )
    return df.filter(F.col(step_col).isNotNull()).select(
        F.col(step_col).alias("step_id"),
        F.lit("error_details").alias("name"),
        F.lit("AI").alias("type"),
        F.lit(1.0).alias("value"),
        text.alias("comment"),
        F.array(F.lit("error"), F.col(type_col)).alias("tags"),
    )


def error_groups(df: DataFrame, type_col: str, message_col: str, ts_col: str) -> DataFrame:
    """Count, and the latest message and time, per error type; of messages at one instant, the greatest."""
    return df.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("errors"),
        F.max_by(message_col, F.struct(ts_col, message_col)).alias("last_message"),
        F.max(ts_col).alias("last_seen"),
    )


def prompt_scores(
    df: DataFrame, completion_col: str, metrics: Sequence[str] = ("duration",), step_col: str = "step_id"
) -> DataFrame:
    """Scores ``prompt_{name}`` of a completion: estimated tokens and given metrics."""
    tokens = F.floor(F.length(completion_col) / 4)
    named = df.withColumn("prompt_tokens", tokens)
    named = named.withColumns({f"prompt_{m}": F.col(m) for m in metrics})
    names = ["prompt_tokens", *[f"prompt_{m}" for m in metrics]]
    return score_rows(named, names, step_col, tags=("prompt", "generation"))


def prompt_usage(df: DataFrame, prompt_col: str, completion_col: str, duration_col: str) -> DataFrame:
    """Calls, estimated tokens and durations per prompt."""
    tokens = F.floor(F.length(completion_col) / 4)
    return df.groupBy(prompt_col).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(tokens).alias("tokens"),
        F.avg(duration_col).alias("avg_duration"),
        F.max(duration_col).alias("max_duration"),
    )

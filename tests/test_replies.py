"""Reply parsing, alerts and thread gaps on hand-made rows."""

from pyspark.sql import functions as F

from threadloom.operators import metrics, replies, summary, threads
from threadloom.streaming import alerts


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    return [r for r in replies.parse_replies(df).orderBy("i").collect()]


def test_metrics(spark):
    (r,) = parse(
        spark,
        "(t, a, 1, 0.5)\n(t, a, 2, x)\n(t, b, nope, 1)\n(t, c)\n) (t, d, 1, 1)\n"
        "x ( t , e , -1e3 , 1 , 2) y\n(t, f, 1.0d, 1)\n<signal_context>",
    )
    assert r.analysis.metrics == {"a": 2.0, "e": -1000.0}
    assert r.metrics["sections"] == 2 and r.metrics["context_length"] == 0


def test_no_marker(spark):
    (r,) = parse(spark, " (t, a, 1, 1) plain ")
    assert r.analysis.thread_analysis == "(t, a, 1, 1) plain"
    assert r.analysis.metrics == {} and r.metrics["analysis_length"] == 20.0


def test_context(spark):
    (r,) = parse(
        spark,
        "x<signal_context>\n- early\nKey Claims:\n- one\n* two\n-\nplain\n"
        "- supporting text: heading after all\n- three\nRisk assessment\n- r",
    )
    assert r.context.key_claims == ["one", "two"]
    assert r.context.supporting_text == ["three"]
    assert r.context.risk_assessment == ["r"] and r.context.viral_potential == []


def test_event_names(spark):
    df = spark.createDataFrame(
        [
            (1, "m<signal_context>Key claims detected: \"A\" claim. More"),
            (2, "no marker Key claims detected: x"),
            (3, "m<signal_context>other"),
            (4, "m<signal_context>a\nKey claims detected: it's " + "y" * 80),
        ],
        "i int, reply string",
    ).withColumn("q", F.lit(0))
    rows = summary.number_events(df, ["q"], ["i"]).orderBy("i").collect()
    assert [(r.event_id, r.event_name) for r in rows] == [
        ("event1", "A claim"),
        ("event2", "its " + "y" * 80),
    ]
    cut = summary.number_events(df, ["q"], ["i"], length=50).orderBy("i").collect()
    assert [r.event_name for r in cut] == ["A claim", "its " + "y" * 45]
    (found,) = summary.structured_results(df, ["q"], ["i"]).collect()
    assert found.event_map == '{"event1":"A claim","event2":"its ' + "y" * 80 + '"}'


def test_rules(spark):
    scores = spark.createDataFrame(
        [("s", "duration", 5.0), ("s", "duration", 5.1), ("s", "success_rate", 0.5), ("s", "other", 9.0)],
        "step_id string, name string, value double",
    ).withColumns({"type": F.lit("AI"), "comment": F.lit(""), "tags": F.array(F.lit("metric"))})
    fired = {(r.name, r.metric_value) for r in metrics.evaluate_rules(scores).collect()}
    assert fired == {("alert_slow_operation", 5.1), ("alert_low_success", 0.5)}


def test_error_rate_of_nothing(spark):
    empty = spark.createDataFrame([], "failed boolean")
    assert metrics.error_rate(empty).first().error_rate == 0.0


def test_gaps_over_empty_hours(spark):
    times = ["00:10:00", "00:10:00", "00:59:00", "03:01:00", "03:30:00"]
    rows = [(i, "a", f"2024-01-01 {t}") for i, t in enumerate(times)] + [(9, "b", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "id int, thread_id string, t string").withColumn(
        "posted_date_time", F.col("t").cast("timestamp")
    )
    got = {r.id: r.gap_seconds for r in threads.reply_gaps(df, "id").collect()}
    assert got == {0: None, 1: 0.0, 2: 2940.0, 3: 7320.0, 4: 1740.0, 9: None}


def test_gaps_in_a_hot_hour(spark):
    """Half of all posts in one thread and hour, in blocks of a few."""
    rows = [(i, "hot" if i % 2 else f"t{i % 14}", i * 37 % 3600 if i % 10 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, thread_id string, s int").withColumn(
        "posted_date_time", F.timestamp_seconds("s")
    )
    got = {r.id: r.gap_seconds for r in threads.reply_gaps(df, "id", block=7).collect()}
    want, last = {}, {}
    for i, t, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[1], r[2], r[0])):
        want[i] = float(s - last[t]) if t in last else None
        last[t] = s
    assert got == want


def test_map_and_boolean_scores(spark):
    df = spark.createDataFrame([("a", {"x": 1.5, "y": None}, True), (None, {"x": 2.0}, False)], "step_id string, m map<string,double>, ok boolean")
    assert [(r.name, r.value) for r in metrics.map_score_rows(df, "m").collect()] == [("x", 1.5)]
    assert [(r.name, r.value) for r in metrics.score_rows(df, ["ok"]).collect()] == [("ok", 1.0)]


def test_late_rows_drop(spark, tmp_path):
    schema = "ts timestamp, failed boolean"
    target, mark = str(tmp_path / "t"), str(tmp_path / "m")
    drops = [
        [("2024-01-01 00:10:00", True), ("2024-01-01 05:00:00", False)],
        [("2024-01-01 00:20:00", True), ("2024-01-01 09:00:00", False)],
    ]
    for i, rows in enumerate(drops):
        df = spark.createDataFrame(rows, "t string, failed boolean")
        df.select(F.col("t").cast("timestamp").alias("ts"), "failed").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        rates = alerts.windowed_error_rate(stream)
        alerts.run_available(rates, target, mark).awaitTermination()
    got = {r.window_start.hour: r.total_operations for r in spark.read.parquet(target).collect()}
    assert got == {0: 1, 5: 1}

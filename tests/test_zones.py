"""Clock changes against the standard library, and ties and numbers of events."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from threadloom.functions import zones
from threadloom.operators import metrics, summary, times

ZONES = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca", "Pacific/Apia"]


def instants(local, zone):
    """The UTC times that a wall-clock time names, by trying both folds."""
    z = ZoneInfo(zone)
    found = set()
    for fold in (0, 1):
        utc = local.replace(tzinfo=z, fold=fold).astimezone(timezone.utc)
        if utc.astimezone(z).replace(tzinfo=None) == local:
            found.add(utc.replace(tzinfo=None))
    return sorted(found)


def readings(local, zone):
    z = ZoneInfo(zone)
    return sorted(local.replace(tzinfo=z, fold=f).astimezone(timezone.utc).replace(tzinfo=None) for f in (0, 1))


@pytest.mark.parametrize("zone", ZONES)
def test_both_edges_of_changes(spark, zone):
    nights = [datetime(y, m, d) for y in (1999, 2011, 2024) for m, d in ((3, 10), (3, 27), (3, 28), (3, 31), (4, 2), (4, 3), (4, 7), (10, 3), (10, 27), (10, 31), (11, 3), (12, 29), (12, 30), (12, 31))]
    steps = [timedelta(minutes=15 * i) for i in range(96)] + [timedelta(hours=h, microseconds=-1) for h in (1, 2, 3)]
    local = sorted({n + s for n in nights for s in steps})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(local)] + [(-1, None)], "id int, local timestamp")
    changes = zones.clock_changes(spark, zone)
    utc = {p: zones.local_to_utc(F.col("local"), zone, changes, p).cast("timestamp_ntz").alias(p) for p in ("null", "earlier", "later")}
    rows = df.select("id", zones.clock_problem(F.col("local"), changes).alias("problem"), *utc.values()).collect()
    met = 0
    for r in rows:
        if r.id < 0:
            assert r.problem is r.null is r.earlier is r.later is None
            continue
        found = instants(local[r.id], zone)
        problem = {0: zones.NON_EXISTENT, 1: None, 2: zones.AMBIGUOUS}[len(found)]
        assert r.problem == problem, local[r.id]
        assert r.null == (found[0] if len(found) == 1 else None)
        assert [r.earlier, r.later] == (readings(local[r.id], zone) if problem else found * 2)
        met += problem is not None
    assert met or zone == "Asia/Kolkata"


def test_times_that_name_two_instants_are_an_error(spark):
    df = spark.createDataFrame([("2024-06-01 12:00:00",), ("2024-11-03 01:30:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    with pytest.raises(Exception, match="ambiguous time in America/New_York: 2024-11-03 01:30:00"):
        times.localize_to_utc(df, "t").collect()
    assert times.localize_to_utc(df.limit(1), "t").first().t == datetime(2024, 6, 1, 16)
    with pytest.raises(ValueError, match="unknown policy"):
        times.localize_to_utc(df, "t", on_change="guess")


def test_a_year_without_rules_is_converted(spark):
    df = spark.createDataFrame([("2300-07-01 12:00:00",), ("1850-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert times.localize_to_utc(df, "t").where("t IS NULL").count() == 0
    assert times.clock_problems(df, "t").where("clock_problem IS NOT NULL").count() == 0


def test_last_of_equal_times(spark):
    rows = [(1, s, "2024-01-01") for s in ("completed", "started")] + [(2, "started", "2024-01-02"), (2, "failed", "2024-01-01")]
    df = spark.createDataFrame(rows, "run_id int, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for parts in (1, 5):
        found = {r.run_id: r.status for r in metrics.run_lifecycle(df.repartition(parts)).collect()}
        assert found == {1: "completed", 2: "started"}
        errors = metrics.error_groups(df.withColumn("type", F.lit("e")).repartition(parts), "type", "status", "ts")
        assert errors.first().last_message == "started"


def test_events_of_a_hot_thread_are_numbered_in_order(spark):
    reply = "x\n<signal_context>\nKey claims detected:\n- Claim {}. more"
    rows = [("hot" if i % 3 else None if i % 2 else f"t{i % 4}", i, reply.format(i) if i % 5 else "none") for i in range(300)]
    df = spark.createDataFrame(rows, "thread_id string, doc_id int, reply string").repartition(6)
    got = summary.number_events(df, ["thread_id"], ["doc_id"])
    assert got.columns == ["thread_id", "doc_id", "reply", "event_name", "event_id"]
    want, seen = {}, {}
    for thread, i, text in rows:
        if text != "none":
            seen[thread] = seen.get(thread, 0) + 1
            want[i] = f"event{seen[thread]}"
    assert {r.doc_id: r.event_id for r in got.collect()} == want

"""Samples and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.base import POSTS, ntz, posts, read
from threadloom.operators import sampling, splitting
from threadloom.plans.prepare import sample_and_split


def smp_by_time(spark, sf):
    return sampling.sample_by_time(read(spark, sf, "events"), "ts", 1000, "event_id")


def smp_by_strata(spark, sf):
    return sampling.sample_by_strata(read(spark, sf, "customer"), "c_mktsegment", 203, "c_custkey")


def smp_by_time_and_strata(spark, sf):
    events = read(spark, sf, "events")
    return sampling.sample_by_time_and_strata(events, "ts", "event_type", 20, "event_id", "D")


# no smaller set of columns names a line
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _lines(spark, sf):
    return read(spark, sf, "lineitem").withColumn("cents", F.expr(CENTS))


def smp_reservoir(spark, sf):
    return sampling.reservoir_sample(_lines(spark, sf), 1000, LINE)


def smp_dispatch(spark, sf):
    """All four ways to the sampling entry, one result each."""
    events = read(spark, sf, "events").withColumn(
        "posted", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    )
    ways = {
        "time": {"time_col": "posted", "strata_col": "None", "filter_date": "2024-01-05"},
        "both": {"time_col": "posted", "strata_col": "event_type"},
        "strata": {"strata_col": "event_type"},
        "none": {},
    }
    result = None
    for way, options in ways.items():
        sample = sampling.stratified_sample(events, 500, "event_id", **options)
        rows = sample.select("event_id", "event_type", F.lit(way).alias("way"))
        result = rows if result is None else result.unionByName(rows)
    return result


def smp_stratified_split(spark, sf):
    events = read(spark, sf, "events")
    return splitting.stratified_split(events, "event_type", "event_id", fraction=0.1)


def smp_split_many_strata(spark, sf):
    events = read(spark, sf, "events").select("event_id", "user_id")
    return splitting.stratified_split(events, "user_id", "event_id", size=300)


def _repeated(spark, sf):
    """Events under a key that repeats and may be null, each row twice."""
    events = read(spark, sf, "events").select(
        F.expr("CASE WHEN user_id % 5 > 0 THEN user_id END").alias("user"), "event_type"
    )
    return events.unionByName(events)


def smp_split_repeated_keys(spark, sf):
    """Rows, subsets and rows per stratum of a split whose key names no row."""
    split = splitting.stratified_split(_repeated(spark, sf), "event_type", "user", size=300)
    counted = split.groupBy("split_id", "event_type").agg(F.count(F.lit(1)).alias("rows"))
    # every subset holds a stratum's share to within one row
    size, total = F.sum("rows").over(W.partitionBy("split_id")), F.sum("rows").over(W.partitionBy())
    share = size * F.sum("rows").over(W.partitionBy("event_type")) / total
    return counted.select(
        "split_id", "event_type", size.alias("size"), (F.abs(F.col("rows") - share) <= 2).alias("even")
    )


def smp_sample_repeated_keys(spark, sf):
    """Sizes of samples whose key names no row."""
    rows = _repeated(spark, sf)
    by_strata = sampling.sample_by_strata(rows, "event_type", 500, "user", cut=False)
    whole = sampling.reservoir_sample(rows, 777, "user").select(F.lit("all").alias("stratum"))
    parts = by_strata.select(F.col("event_type").alias("stratum")).unionByName(whole)
    return parts.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"))


def smp_plain_split(spark, sf):
    items = _lines(spark, sf).select(*LINE, "l_quantity")
    return splitting.plain_split(items, LINE, fraction=0.15, seed=7)


def smp_prepare(spark, sf):
    """Date filter, hourly sample, split by full time: the preparing job."""
    split = sample_and_split(posts(spark, sf), "doc_id", 400, "2024-01-01")
    return split.select("doc_id", ntz("posted_date_time").alias("posted_date_time"), "split_id")


QUERIES = {
    f.__name__: f
    for f in (
        smp_by_time, smp_by_strata, smp_by_time_and_strata, smp_reservoir, smp_dispatch,
        smp_stratified_split, smp_split_many_strata, smp_split_repeated_keys,
        smp_sample_repeated_keys, smp_plain_split, smp_prepare,
    )
}


def _cut(rows: str, k: int, key: str, seed: int = 42) -> str:
    return f"(SELECT * FROM ({rows}) ORDER BY md5('{seed}/cut|' || {key}), {key} LIMIT {k})"


def _by_time(table: str, time: str, k: int, key: str, columns: str) -> str:
    picked = f"""SELECT {columns} FROM (
        SELECT *, count(*) OVER (PARTITION BY b) AS n,
               row_number() OVER (PARTITION BY b ORDER BY md5('42|' || {key})) AS rn
        FROM (SELECT *, date_trunc('hour', {time}) AS b FROM {table}))
      WHERE rn <= round_even(least(1.0, {k}.0 / (SELECT count(*) FROM {table})) * n, 0)"""
    return _cut(picked, k, key)


def _by_strata(table: str, strata: str, k: int, key: str, columns: str) -> str:
    picked = f"""SELECT {columns} FROM (
        SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5('42|' || {key})) AS rn FROM {table})
      WHERE rn <= {k} // (SELECT count(DISTINCT {strata}) FROM {table})"""
    return _cut(picked, k, key)


def _by_both(table: str, unit: str, strata: str, k: int, key: str, columns: str) -> str:
    picked = f"""SELECT {columns} FROM (
        SELECT *, row_number() OVER (PARTITION BY b, {strata} ORDER BY md5('42|' || {key})) AS rn
        FROM (SELECT *, date_trunc('{unit}', ts) AS b FROM {table}))
      JOIN (SELECT date_trunc('{unit}', ts) AS b, {k} // count(DISTINCT {strata}) AS share
            FROM {table} GROUP BY 1) USING (b)
      WHERE rn <= share"""
    return _cut(picked, k, key)


def _line_key(seed: int) -> str:
    return f"concat_ws('|', '{seed}', {', '.join(CENTS if c == 'cents' else c for c in LINE)})"


_EVENT = "event_id, ts, user_id, event_type, value, props"
_WAY = "event_id, event_type"

ORACLES = {
    "smp_by_time": "SELECT * FROM " + _by_time("events", "ts", 1000, "event_id", _EVENT),
    "smp_by_strata": "SELECT * FROM " + _by_strata(
        "customer", "c_mktsegment", 203, "c_custkey",
        "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    ),
    "smp_by_time_and_strata": "SELECT * FROM "
    + _by_both("events", "day", "event_type", 20, "event_id", _EVENT),
    "smp_reservoir": f"""SELECT *, {CENTS} AS cents FROM lineitem
        ORDER BY md5({_line_key(42)}) LIMIT 1000""",
    "smp_dispatch": f"""WITH late AS (SELECT *, date_trunc('second', ts) AS t FROM events
          WHERE CAST(ts AS DATE) > DATE '2024-01-05')
        SELECT *, 'time' AS way FROM {_by_time('late', 't', 500, 'event_id', _WAY)}
        UNION ALL SELECT *, 'both' AS way FROM {_by_both('events', 'hour', 'event_type', 500, 'event_id', _WAY)}
        UNION ALL SELECT *, 'strata' AS way FROM {_by_strata('events', 'event_type', 500, 'event_id', _WAY)}
        UNION ALL SELECT *, 'none' AS way FROM
          (SELECT {_WAY} FROM events ORDER BY md5('42|' || event_id) LIMIT 500)""",
    "smp_stratified_split": f"""WITH ranked AS (
          SELECT *, md5('42|' || event_id) AS h, count(*) OVER (PARTITION BY event_type) AS n,
                 row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id)) AS rn FROM events),
        phased AS (SELECT *, CAST(('0x' || substr(md5('42/phase|=' || event_type), 1, 12)) AS BIGINT)::DOUBLE
          / 281474976710656::DOUBLE AS phase FROM ranked),
        placed AS (SELECT *, row_number() OVER (ORDER BY (rn - phase) / n, h) - 1 AS place FROM phased)
        SELECT {_EVENT}, place // (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM events) AS split_id
        FROM placed""",
    "smp_split_many_strata": """WITH ranked AS (
          SELECT *, md5('42|' || event_id) AS h, count(*) OVER (PARTITION BY user_id) AS n,
                 row_number() OVER (PARTITION BY user_id ORDER BY md5('42|' || event_id)) AS rn,
                 CAST(('0x' || substr(md5('42/phase|=' || user_id), 1, 12)) AS BIGINT)::DOUBLE
                   / 281474976710656::DOUBLE AS phase
          FROM events),
        placed AS (SELECT *, row_number() OVER (ORDER BY (rn - phase) / n, h) - 1 AS place FROM ranked)
        SELECT event_id, user_id, place // 300 AS split_id FROM placed""",
    "smp_split_repeated_keys": """WITH n AS (SELECT 2 * count(*) AS n FROM events),
        ids AS (SELECT unnest(range(0, (n + 299) // 300)) AS split_id, n FROM n),
        t AS (SELECT event_type, 2 * count(*) AS m FROM events GROUP BY 1),
        pairs AS (SELECT split_id, event_type, least(300, n - split_id * 300) AS size, m, n FROM ids, t)
        SELECT split_id, event_type, CAST(size AS BIGINT) AS size, true AS even FROM pairs""",
    "smp_sample_repeated_keys": """SELECT event_type AS stratum,
          least(2 * count(*), 500 // (SELECT count(DISTINCT event_type) FROM events)) AS rows
        FROM events GROUP BY 1 UNION ALL SELECT 'all', least(777, 2 * (SELECT count(*) FROM events))""",
    "smp_plain_split": f"""WITH size AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.15) AS BIGINT) AS s
          FROM lineitem),
        lines AS (SELECT *, {CENTS} AS cents FROM lineitem),
        placed AS (SELECT *, row_number() OVER (ORDER BY md5({_line_key(7)})) - 1 AS place FROM lines)
        SELECT {", ".join(LINE)}, l_quantity, place // s AS split_id
        FROM placed, size WHERE place // s < n // s""",
    "smp_prepare": f"""WITH {POSTS},
        late AS (SELECT * FROM posts WHERE CAST(posted_date_time AS DATE) > DATE '2024-01-01'),
        sample AS (SELECT * FROM {_by_time('late', 'posted_date_time', 400, 'doc_id', 'doc_id, posted_date_time')}),
        ranked AS (SELECT *, md5('42|' || doc_id) AS h, count(*) OVER (PARTITION BY posted_date_time) AS n,
            row_number() OVER (PARTITION BY posted_date_time ORDER BY md5('42|' || doc_id)) AS rn,
            CAST(('0x' || substr(md5('42/phase|=' || CAST(posted_date_time AS VARCHAR)), 1, 12)) AS BIGINT)::DOUBLE
              / 281474976710656::DOUBLE AS phase FROM sample),
        placed AS (SELECT *, row_number() OVER (ORDER BY (rn - phase) / n, h) - 1 AS place FROM ranked)
        SELECT doc_id, posted_date_time,
               place // (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM sample) AS split_id
        FROM placed""",
}

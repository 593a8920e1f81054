"""Filters, projections and date operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import POSTS, SQL_TIME_TEXT, W, ntz, posts, read, sql_strip
from threadloom.functions import dates as D
from threadloom.functions import text as T
from threadloom.operators import filters, times

# events with times as text: of errors unreadable, of views with a zone suffix
TEXT_TIMES = """CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN concat({t}, '+00:00')
  ELSE {t} END"""


def _text_times(spark, sf):
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    when = (
        F.when(F.col("event_type") == "error", "n/a")
        .when(F.col("event_type") == "view", F.concat(t, F.lit("+00:00")))
        .otherwise(t)
    )
    return read(spark, sf, "events").select("event_id", "event_type", "ts", when.alias("t"))


_T = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
TIMES = f"""times AS (SELECT event_id, event_type, ts, {TEXT_TIMES.format(t=_T)} AS t,
  date_trunc('second', ts) AS s FROM events)"""
PARSED = "CASE WHEN event_type <> 'error' THEN s END"


def flt_after_date(spark, sf):
    return filters.after_date(read(spark, sf, "events"), "ts", "2024-01-10")


def flt_date_range(spark, sf):
    orders = read(spark, sf, "orders")
    return filters.date_range(orders, "o_orderdate", "1995-01-01", "1996-12-31 00:00:00")


def flt_date_range_text(spark, sf):
    found = filters.date_range(_text_times(spark, sf), "t", "2024-01-05", "2024-01-20 12:00:00")
    return found.select("event_id", ntz("t").alias("t"))


def flt_open_range(spark, sf):
    """Ranges with open ends: the bounds vary by row, some are null."""
    e = _text_times(spark, sf)
    start = F.when(F.col("event_type") == "click", F.lit("2024-01-10").cast("timestamp"))
    end = F.when(F.col("event_type") != "view", F.lit("2024-01-20").cast("timestamp"))
    t = D.to_time(F.col("t"))
    return e.select("event_id", D.in_range(t, start, end).alias("inside"))


def flt_drop_null_dates(spark, sf):
    e = times.parse_times(_text_times(spark, sf), "t")
    return filters.drop_null_dates(e, "t", "ts").select("event_id", ntz("t").alias("t"))


#: whole texts, and short ones with white space that only counts untrimmed
PADDED = "CASE WHEN turn % 3 > 0 THEN concat(' ', text) ELSE concat(role, repeat(' ', CAST(turn * 4 AS INT))) END"


def flt_min_length(spark, sf):
    c = read(spark, sf, "conversations").withColumn("text", F.expr(PADDED))
    return filters.long_enough(filters.long_enough(c, "text", 20), "text", 20, trimmed=True)


def flt_non_blank(spark, sf):
    d = read(spark, sf, "documents").select(
        "doc_id", F.expr("CASE lang WHEN 'de' THEN concat(chr(9), ' ', chr(10)) WHEN 'fr' THEN NULL ELSE text END").alias("text")
    )
    return filters.non_blank(d, "text")


VALID_TEXT = "concat('<content>old</content> <content>', chr(10), CASE WHEN doc_id % 3 > 0 THEN text ELSE source END, '</content> end')"


def flt_valid_chunk(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", T.is_valid_chunk(F.expr(VALID_TEXT)).alias("valid"))


def prj_rename(spark, sf):
    p = posts(spark, sf).select("thread_id", ntz("posted_date_time"), "text", "lang")
    return filters.rename_positionally(p, "a", "b", "c", "d")


def prj_temporal_wrap(spark, sf):
    p = posts(spark, sf)
    posted = D.time_text(F.col("posted_date_time"))
    framed = T.temporal_wrap(F.col("text"), posted, F.col("thread_id"))
    return p.select("doc_id", framed.alias("framed"))


def dt_parse(spark, sf):
    e = times.parse_times(_text_times(spark, sf), "t")
    return e.select("event_id", ntz("t").alias("t"))


def dt_local_to_utc(spark, sf):
    e = times.localize_to_utc(read(spark, sf, "events"), "ts")
    return e.select("event_id", ntz("ts").alias("ts"))


def dt_clock_changes(spark, sf):
    """The events' hours on a night of either clock change: which are no or two instants, and both readings."""
    e = read(spark, sf, "events")
    night = F.when(F.col("event_type") == "click", F.lit("2024-03-10")).otherwise(F.lit("2024-11-03"))
    local = F.concat_ws(" ", night, F.date_format("ts", "HH:mm:ss")).cast("timestamp")
    found = times.clock_problems(e.select("event_id", local.alias("local")), "local")
    found = found.withColumns({"earlier": F.col("local"), "later": F.col("local")})
    for c in ("earlier", "later"):
        found = times.localize_to_utc(found, c, on_change=c)
    return found.select("event_id", "clock_problem", ntz("earlier").alias("earlier"), ntz("later").alias("later"))


def dt_shift_hours(spark, sf):
    e = times.shift_back(read(spark, sf, "events"), "ts", hours=5)
    return e.select("event_id", ntz("ts").alias("ts"))


def dt_format_dates(spark, sf):
    e = _text_times(spark, sf).select(
        "event_id", F.col("ts").alias("posted_date_time"), F.col("t").alias("collected_date_time")
    )
    done = times.format_dates(e)
    return done.withColumn("posted_date_time", ntz("posted_date_time"))


def dt_add_days(spark, sf):
    o = times.add_days(read(spark, sf, "orders"), "o_orderdate", 45)
    return o.select("o_orderkey", ntz("o_orderdate").alias("later"))


def dt_subtract_days(spark, sf):
    o = times.subtract_days(_text_times(spark, sf), "t", 45)
    return o.select("event_id", ntz("t").alias("earlier"))


def dt_hour_key(spark, sf):
    """From ``date_hour`` where there is one, else from ``Timestamp``, floored too."""
    e = _text_times(spark, sf)
    own = times.hour_keys(e.select("event_id", F.col("t").alias("date_hour")))
    other = times.hour_keys(e.select("event_id", F.col("t").alias("Timestamp")))
    other = other.select(
        "event_id", ntz("Timestamp").alias("floored"), F.col("date_hour").alias("other_hour")
    )
    return own.join(other, "event_id")


def dt_to_text(spark, sf):
    e = _text_times(spark, sf)
    shown = D.format_time(D.to_time(F.col("t")), "%d/%m/%Y %H:%M")
    return e.select("event_id", shown.alias("shown"))


def dt_safe_parse(spark, sf):
    e = _text_times(spark, sf)
    return e.select("event_id", ntz(D.parse_time(F.col("t"), "%Y-%m-%d %H:%M:%S")).alias("t"))


def dt_standardize(spark, sf):
    readable = _text_times(spark, sf).filter("event_type <> 'error'")
    e = times.standardize_time(readable, "t", "2024-01-12")
    return e.select("event_id", ntz("t").alias("t"))


def dt_extent(spark, sf):
    return times.temporal_extent(posts(spark, sf), "posted_date_time", "lang")


QUERIES = {
    f.__name__: f
    for f in (
        flt_after_date, flt_date_range, flt_date_range_text, flt_open_range, flt_drop_null_dates,
        flt_min_length, flt_non_blank, flt_valid_chunk, prj_rename, prj_temporal_wrap, dt_parse,
        dt_local_to_utc, dt_clock_changes, dt_shift_hours, dt_format_dates, dt_add_days, dt_subtract_days,
        dt_hour_key, dt_to_text, dt_safe_parse, dt_standardize, dt_extent,
    )
}

_CONTENT = sql_strip(
    "split_part(list_extract(string_split(x, '<content>'), -1), '</content>', 1)"
)

ORACLES = {
    "flt_after_date": "SELECT * FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-10'",
    "flt_date_range": """SELECT * FROM orders
        WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'""",
    "flt_date_range_text": f"""WITH {TIMES} SELECT event_id, {PARSED} AS t FROM times
        WHERE {PARSED} BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""",
    "flt_open_range": f"""WITH {TIMES} SELECT event_id, coalesce(({PARSED}) IS NOT NULL
        AND (event_type <> 'click' OR s >= TIMESTAMP '2024-01-10')
        AND (event_type = 'view' OR s <= TIMESTAMP '2024-01-20'), false) AS inside FROM times""",
    "flt_drop_null_dates": f"WITH {TIMES} SELECT event_id, s AS t FROM times WHERE event_type <> 'error'",
    "flt_min_length": f"""WITH c AS (SELECT * REPLACE ({PADDED} AS text)
        FROM conversations)
        SELECT * FROM c WHERE length(text) >= 20 AND length({sql_strip('text')}) >= 20""",
    "flt_non_blank": "SELECT doc_id, text FROM documents WHERE lang NOT IN ('de', 'fr')",
    "flt_valid_chunk": f"""WITH x AS (SELECT doc_id, {VALID_TEXT} AS x FROM documents),
        c AS (SELECT doc_id, {_CONTENT} AS c FROM x)
        SELECT doc_id, len(list_filter(regexp_split_to_array(c, '{W}+'), lambda w: length(w) > 2)) >= 5
          AND length(c) >= 20 AS valid FROM c""",
    "prj_rename": f"""WITH {POSTS} SELECT thread_id AS a, posted_date_time AS b, text AS c, lang AS d
        FROM posts""",
    "prj_temporal_wrap": f"""WITH {POSTS} SELECT doc_id, concat_ws(chr(10), '<temporal_context>',
        'Posted: ' || {SQL_TIME_TEXT},
        'Thread: ' || thread_id, '</temporal_context>', '<content>', text, '</content>') AS framed
        FROM posts""",
    "dt_parse": f"WITH {TIMES} SELECT event_id, {PARSED} AS t FROM times",
    "dt_local_to_utc": "SELECT event_id, ts + INTERVAL 5 HOUR AS ts FROM events",
    "dt_clock_changes": """WITH l AS (SELECT event_id, event_type = 'click' AS spring, hour(ts) AS h,
          (CASE WHEN event_type = 'click' THEN DATE '2024-03-10' ELSE DATE '2024-11-03' END)
          + CAST(date_trunc('second', ts) AS TIME) AS local FROM events),
        p AS (SELECT *, CASE WHEN spring AND h = 2 THEN 'non-existent' WHEN NOT spring AND h = 1 THEN 'ambiguous' END
          AS clock_problem, CASE WHEN (spring AND h < 2) OR (NOT spring AND h > 1) THEN 5 ELSE 4 END AS hours FROM l)
        SELECT event_id, clock_problem, local + to_hours(hours) AS earlier,
          local + to_hours(hours + CASE WHEN clock_problem IS NULL THEN 0 ELSE 1 END) AS later FROM p""",
    "dt_shift_hours": "SELECT event_id, ts - INTERVAL 5 HOUR AS ts FROM events",
    "dt_format_dates": f"""WITH {TIMES} SELECT event_id, ts AS posted_date_time,
        strftime(s - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS collected_date_time,
        strftime(s - INTERVAL 2 HOUR, '%Y-%m-%d %H') AS collected_date_hour
        FROM times WHERE event_type <> 'error'""",
    "dt_add_days": "SELECT o_orderkey, o_orderdate + INTERVAL 45 DAY AS later FROM orders",
    "dt_subtract_days": f"""WITH {TIMES} SELECT event_id, ({PARSED}) - INTERVAL 45 DAY AS earlier
        FROM times""",
    "dt_hour_key": f"""WITH {TIMES}, h AS (SELECT event_id, date_trunc('hour', {PARSED}) AS h FROM times)
        SELECT event_id, strftime(h, '%Y-%m-%d %H') AS date_hour, CAST(h AS TIMESTAMP) AS floored,
               strftime(h, '%Y-%m-%d %H') AS other_hour FROM h""",
    "dt_to_text": f"WITH {TIMES} SELECT event_id, strftime({PARSED}, '%d/%m/%Y %H:%M') AS shown FROM times",
    "dt_safe_parse": f"""WITH {TIMES} SELECT event_id,
        CASE WHEN event_type NOT IN ('error', 'view') THEN s END AS t FROM times""",
    "dt_standardize": f"""WITH {TIMES} SELECT event_id, s AS t FROM times
        WHERE event_type <> 'error' AND CAST(s AS DATE) > DATE '2024-01-12'""",
    "dt_extent": f"""WITH {POSTS} SELECT lang, strftime(min(posted_date_time), '%Y-%m-%d %H:%M:%S') AS start_date,
        strftime(max(posted_date_time), '%Y-%m-%d %H:%M:%S') AS end_date FROM posts GROUP BY lang""",
}

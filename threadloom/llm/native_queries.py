"""Queries of the operators that are expressions only, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, pii, quality_rules, secrets
from threadloom.llm import text as tx
from threadloom.llm.tables import read, scratch


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    n_hit = tx.covered(F.col("spans")).cast("bigint")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(read(spark, sf, "documents"), scratch(spark, "ledger"))
    kinds = [r.kind for r in secrets.BASE_RULES]

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(tx.listed(base), 256).alias("base_sha256"),
        tx.listed(F.col("spans")).alias("spans"),
    )


def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.detect(read(spark, sf, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(tx.listed(F.col("base")), 256).alias("base_sha256"),
        tx.listed(F.concat("base", "more")).alias("spans"),
    )


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


QUERIES = {f.__name__: f for f in (op5_decontaminate, op6_secrets, op7_pii, op9_quality_rules)}


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_WORDS5 = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), "
    f"'{tx.ASCII_UPPER}', '{tx.ASCII_LOWER}'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)

ORACLES = {
    "op5_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS5} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS5} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
         unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, sizes WHERE len(w) >= size),
hit AS (
  SELECT DISTINCT r, i, dw.size, item FROM dw JOIN bw
  ON bw.size = dw.size AND bw.win = array_to_string(w[i : i + dw.size - 1], ' ')),
places AS (SELECT r, count(DISTINCT p) AS n_hit
           FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items,
                 array_to_string(list_sort(list_distinct(list(item))), ',') AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
keyed AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i : i + 7], ' ')) AS n FROM win),
rep AS (SELECT r, count(DISTINCT p) AS n FROM
        (SELECT r, unnest(range(i, i + 8)) AS p FROM keyed WHERE n > 1) GROUP BY r),
c AS (
  SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS n_excl,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
    len(list_filter(w, lambda x: lower(x) IN ({_sql_list(quality_rules.STOP_WORDS)}))) AS n_stop,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter,
    len(lines) AS n_lines
  FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 20 AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 20
  AND n_symbols / greatest(n_words, 1) <= 0.1 AND n_excl / greatest(n_words, 1) <= 0.25
  AND n_upper / greatest(word_chars, 1) <= 0.4 AND n_stop / greatest(n_words, 1) >= 0.02
  AND n_repeat_words / greatest(n_words, 1) <= 0.3 AND n_stutter / greatest(n_words, 1) <= 0.2
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM f
""",
}


def _sql_spans(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Named spans of one kind, from what stands between the matches."""
    p = pattern.replace("'", "''")
    return f"""
SELECT r, {rank} AS rank, '{kind}' AS kind, stop - length(m) AS start, stop FROM (
  SELECT r, m[i] AS m, CAST(list_sum(list_transform(gaps[1 : i], lambda g: length(g)))
         + list_sum(list_transform(m[1 : i], lambda x: length(x))) AS BIGINT) AS stop
  FROM (SELECT r, m, gaps, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS gaps FROM d)))
WHERE {keep.format(m="m")}"""


def _op6_sql() -> str:
    either = "".join
    words = [
        either(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
        for w in ("password", "passwd", "secret", "token", "api_?key")
    ]
    assign = f"({'|'.join(words)})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    length_of_value = f"length(regexp_extract({{m}}, '{assign.replace(chr(39), chr(39) * 2)}', 2)) >= 6"
    parts = [
        _sql_spans("assign", 0, assign, length_of_value.replace("{m}", "m")),
        _sql_spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20"),
        _sql_spans("hex", 2, "[0-9a-f]+", "length(m) >= 24"),
    ]
    for rank, rule in enumerate(secrets.MORE_RULES, 3):
        parts.append(_sql_spans(rule.kind, rank, rule.pattern, f"length(m) >= {rule.least}"))
    listed = "array_to_string(list(kind || ':' || start || ':' || stop ORDER BY start, rank), ',')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, {listed} AS spans,
        array_to_string(list(kind || ':' || start || ':' || stop ORDER BY start, rank)
                        FILTER (rank < 3), ',') AS base FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


ORACLES["op6_secrets"] = _op6_sql()

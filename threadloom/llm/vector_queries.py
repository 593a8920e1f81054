"""Queries of exact retrieval, fill-in-the-middle and whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import infill, products, whitening
from threadloom.llm.tables import read

ASKED_EVERY = 20
BEST = 20


def op11_top_products(spark: SparkSession, sf: str) -> DataFrame:
    return products.top_products(read(spark, sf, "embeddings"), F.col("id") % ASKED_EVERY == 0, BEST)


def op12_infill(spark: SparkSession, sf: str) -> DataFrame:
    made = infill.transform(read(spark, sf, "documents").select("doc_id", "text"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        "output_sha256",
        restored["sha256"].alias("restored_sha256"),
    )


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(read(spark, sf, "embeddings"))


QUERIES = {f.__name__: f for f in (op11_top_products, op12_infill, op13_whitening)}

ORACLES = {
    "op11_top_products": f"""
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id,
         list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (
  SELECT q.u, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.u <> q.u WHERE q.vec_id % {ASKED_EVERY} = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score
FROM p WINDOW w AS (PARTITION BY u ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {BEST}
""",
    "op12_infill": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
l AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
         greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM l),
p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
         array_to_string(lines[b + 1:], '') AS suffix
  FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM p),
i AS (SELECT *, instr(output, '<P>') AS ip, instr(output, '<S>') AS s, instr(output, '<M>') AS m FROM o)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN substr(output, 4, s - 4) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
              ELSE substr(output, ip + 3, m - ip - 3) || substr(output, m + 3) || substr(output, 4, ip - 4)
              END) AS restored_sha256
FROM i
""",
}

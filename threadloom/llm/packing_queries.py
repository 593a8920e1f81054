"""Queries of near-duplicates, shards and packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import packing, sharding, simhash
from threadloom.llm.tables import per_worker, read

TOKENIZER = "word_bpe_49k.json"
#: small enough that the small test tables split, too
SHARD_BYTES = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encoder(path: str) -> Callable[[], packing.Encoder]:
    """Loads the tokenizer of ``path`` when a worker first needs it."""
    return lambda: per_worker(f"encoder {path}", lambda: packing.word_encoder(path))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.duplicates(read(spark, sf, "documents"))


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(read(spark, sf, "documents"), SHARD_BYTES)


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), encoder(tokenizer_path()))


QUERIES = {f.__name__: f for f in (op3_simhash, op8_sharding, op10_packing)}

ORACLES = {
    "op8_sharding": f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
p AS (SELECT *, unnest(range(0, 49)) AS depth FROM d),
n AS (SELECT *, h >> (48 - depth) AS prefix FROM p),
s AS (SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs
      FROM n WINDOW w AS (PARTITION BY depth, prefix))
SELECT doc_id, n_bytes, substr(right(repeat('0', 48) || bin(h), 48), 1, depth) AS shard,
       CAST(depth AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM s WHERE shard_bytes <= {SHARD_BYTES}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
""",
}

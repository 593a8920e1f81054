"""SimHash near-duplicates by multi-index hashing.

A fingerprint sums up a text's word shingles in 64 bits. Two fingerprints that
differ in at most four bits differ in at most two within one of their halves, so
some 32-bit word is within one bit of both halves. Each distinct fingerprint
therefore enumerates the ball of radius one around either half (66 keys) and
fingerprints that meet under a key are compared in full.

Keys are counted before anything meets. Under a key with two fingerprints the
pair is the least and the greatest. Up to ``CROWD`` are gathered in a row and
searched for their components, each found fingerprint being compared only with
those not found yet, so a group of near copies costs little more than its size;
what leaves the row is a tree, never all pairs. A more crowded key is not
gathered: its fingerprints enumerate the ball of radius two in all 64 bits,
where any two that meet are within four bits, so each is linked to the least
that it meets. That way is exact as well and linear, so no size of group is
dropped, capped or squared.

Defined results: null, empty and word-less texts have fingerprint zero and link
like any other. Null keys and repeated rows are kept; a group's id is its least
key that is not null, and null where all its keys are. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.components import components
from threadloom.llm.tables import stored
from threadloom.sizing import BROADCAST_ROWS

BITS = 4
SHINGLE = 4
SEED = 42
CROWD = 8192
#: shingles hashed at a time, which bounds the memory of a long text
BLOCK = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], stops[:-1] + 1)).tolist()
    ends = stops.tolist()
    size = min(shingle, len(words))
    n = len(words) - size + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for first in range(0, n, BLOCK):
        last = min(first + BLOCK, n)
        spans = zip(starts[first:last], ends[first + size - 1 : last + size - 1])
        hashes = np.array([digest(joined[i:j], seed) for i, j in spans], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def fingerprint(text: Column) -> Column:
    """The fingerprints of a column of texts, batch by batch."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fps: DataFrame) -> DataFrame:
    """``key, fp``: either half of a fingerprint with none or one of its bits turned."""
    masks = [0] + [1 << i for i in range(32)]
    turns = F.array(
        *[F.struct(F.lit(s).alias("shift"), F.lit(m).cast("bigint").alias("mask")) for s in (0, 32) for m in masks]
    )
    rows = fps.select("fp", F.explode(turns).alias("t"))
    half = F.call_function("shiftrightunsigned", F.col("fp"), F.col("t.shift"))
    value = half.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.col("t.mask"))
    # the half goes into bit 32, above the value
    which = F.when(F.col("t.shift") == 32, F.lit(1 << 32)).otherwise(F.lit(0).cast("bigint"))
    return rows.select(value.bitwiseOR(which).alias("key"), "fp")


def _points(fps: DataFrame) -> DataFrame:
    """``point, fp``: a fingerprint with one or two of its 64 bits turned."""
    one = [1 << i for i in range(64)]
    two = [one[i] | one[j] for i in range(64) for j in range(i)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in one + two]
    masks = F.expr("array(" + ",".join(f"{m}L" for m in signed) + ")")
    rows = fps.select("fp", F.explode(masks).alias("mask"))
    return rows.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp")


def tree_of(group: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links of at most ``BITS`` bits connect within one group."""
    left, edges = np.unique(group), []
    while len(left) > 1:
        found, left = [int(left[0])], left[1:]
        while found and len(left):
            a = found.pop()
            # of unsigned numbers: a negative one would be counted by its absolute value
            near = np.bitwise_count((left ^ np.int64(a)).view(np.uint64)) <= BITS
            met = left[near].tolist()
            edges += [(a, b) for b in met]
            found += met
            left = left[~near]
    return edges


def _tree(group: Column) -> Column:
    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def of(groups: pd.Series) -> pd.Series:
        return pd.Series([tree_of(np.asarray(g, dtype=np.int64)) for g in groups], dtype=object)

    return of(group)


def _small(keys: DataFrame) -> DataFrame:
    """Stored keys for a join: broadcast if they are few, else merged."""
    n = keys.count()
    return F.broadcast(keys) if n <= BROADCAST_ROWS else keys.hint("merge")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints of at most ``BITS`` differing bits.

    The edges connect exactly what all such pairs would connect; pairs under a
    crowded key are linked through the least fingerprint that shares a point.
    """
    # eight bytes become sixty-six rows: deal them out first
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = _keys(fps).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    )
    counted = stored(counted.where("n > 1"), "keys")
    near = _differ(F.col("a"), F.col("b")) <= BITS
    twos = counted.where("n = 2").select("a", "b").where(near)

    few = _keys(fps).join(_small(counted.where(F.col("n").between(3, crowd)).select("key")), "key")
    groups = few.groupBy("key").agg(F.collect_list("fp").alias("g"))
    grown = groups.select(F.explode(_tree(F.col("g"))).alias("p")).select("p.a", "p.b")

    crowded = _small(counted.where(F.col("n") > crowd).select("key"))
    dense = _keys(fps).join(crowded, "key", "left_semi")
    dense = stored(dense.select("fp").distinct(), "dense")
    edges = twos.unionByName(grown)
    if not dense.isEmpty():
        points = _points(dense)
        hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n"))
        # an exploded frame looks small to the planner
        met = points.join(hubs.where("n > 1").select("point", "hub").hint("merge"), "point")
        stars = met.select(F.col("hub").alias("a"), F.col("fp").alias("b")).where("a <> b")
        edges = edges.unionByName(stars.where(near))
    return edges.distinct()


def _grouped(rows: DataFrame) -> DataFrame:
    """``fp, root`` for all distinct fingerprints of ``rows``."""
    fps = stored(rows.select("fp").distinct(), "fingerprints")
    roots = components(links(fps))
    joined = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``fingerprint`` in hex and ``component_id``."""
    rows = docs.select(F.col(key).alias("id"), fingerprint(F.col(text)).alias("fp"))
    rows = stored(rows, "documents")
    first = rows.groupBy("fp").agg(F.min("id").alias("first"))
    rooted = stored(first.join(_grouped(rows), "fp"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select(
        F.col("id").alias(key),
        as_hex(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, all columns: the one with the least key.

    Rows that repeat key and text count as one document. A document without a
    key stays only if its group has none with a key.
    """
    name = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.sha2(F.col(text), 256)), 256)
    rows = docs.select(
        F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), name.alias("name")).alias("row"),
        fingerprint(F.col(text)).alias("fp"),
    )
    rows = stored(rows, "documents")
    first = rows.groupBy("fp").agg(F.min("row").alias("first"))
    least = first.join(_grouped(rows), "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = least.select(F.col("first.name").alias("name"))
    own = docs.select(F.struct(*docs.columns).alias("own"), name.alias("name"))
    return own.dropDuplicates(["name"]).join(chosen, "name", "left_semi").select("own.*")

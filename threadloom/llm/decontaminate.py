"""Benchmark decontamination: token windows of the corpus against a set of benchmark windows.

The hashes of all benchmark windows form a set that travels with the plan. Each
document's windows are hashed inside its own row and looked up in it; only
windows that hit leave the row, with their words, and are verified by an
equality join against the benchmark's windows. A document that hits nothing
costs no shuffled byte. Hits belong to a text, named by its digest, so copies
are settled once and the result does not depend on where rows lie.

The set is bounded: past ``SET_WINDOWS`` windows the benchmark is cut into
blocks by hash and each block makes one scan, with the same result.

Defined results: a null or word-less text has no words and no hits; a word-less
item has no windows. Items repeated under one id count once; a null item id is
an item named by the empty string. Repeated rows and null keys stay apart, each
with its own result. Other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.strings import let
from threadloom.llm import text as tx
from threadloom.session import materialise
from threadloom.sizing import broadcast_measured

WINDOW = 10
SET_WINDOWS = 50_000

#: what is not a letter or digit, after lower-casing A-Z (fixed by the word definition)
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same words in a text that is not lower-cased
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and everything beyond ASCII."""
    lowered = F.translate(text, tx.ASCII_UPPER, tx.ASCII_LOWER)
    return tx.words_of(lowered, BREAKS)


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def benchmark_windows(
    benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Distinct windows: ``size``, ``hash``, ``window`` (its words) and the ``items`` that have it."""
    items = benchmark.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"),
        normal_words(F.col(text)).alias("w"),
    ).where(F.size("w") > 0)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(window)))
    starts = tx.indexes(0, F.size("w") - F.col("size") + 1)
    cut = F.transform(starts, lambda i: F.slice("w", i + 1, F.col("size")))
    windows = items.select("item", "size", F.explode(cut).alias("words"))
    return (
        windows.select(
            "item",
            "size",
            F.xxhash64(tx.word_hashes(F.col("words"))).alias("hash"),
            F.array_join("words", " ").alias("window"),
        )
        .groupBy("size", "hash", "window")
        .agg(F.collect_set("item").alias("items"))
    )


def _candidates(hashes_of: dict[int, list[int]]) -> Callable[[Column], Column]:
    """From words to the windows whose hash is in the set: ``start``, ``size`` and their words."""

    def of_size(words: Column, hashes: Column, size: int, values: list[int]) -> Column:
        inside = F.filter(
            tx.indexes(0, F.size(hashes) - (size - 1)),
            lambda i: tx.window_hash(hashes, i, size).isin(values),
        )
        return F.transform(
            inside,
            lambda i: F.struct(
                i.alias("start"),
                F.lit(size).alias("size"),
                F.array_join(F.slice(words, i + 1, F.lit(size)), " ").alias("window"),
            ),
        )

    def of_words(words: Column) -> Column:
        return let(
            tx.word_hashes(words),
            lambda h: F.concat(*[of_size(words, h, s, v) for s, v in sorted(hashes_of.items())]),
        )

    return of_words


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    set_windows: int = SET_WINDOWS,
) -> DataFrame:
    """Per distinct text that has any: ``digest``, ``spans`` of hit words and ``items``.

    ``spans`` are ``start, stop`` in word places, in order and verified, one per
    occurrence; ``items`` are the sorted ids of the items with a window there.
    """
    known = materialise(benchmark_windows(benchmark, item_key, item_text, window))
    lookup = broadcast_measured(known.select("window", "items"))
    n_blocks = max(1, -(-known.count() // set_windows))
    texts = docs.select(F.col(text).alias("text"))
    found = None
    for block in range(n_blocks):
        hashes_of: dict[int, list[int]] = {}
        picked = known.where(F.pmod("hash", F.lit(n_blocks)) == block).select("size", "hash")
        for row in picked.distinct().collect():
            hashes_of.setdefault(row["size"], []).append(row["hash"])
        if not hashes_of:
            hashes_of = {window: [0]}
        in_row = let(normal_words(F.col("text")), _candidates(hashes_of))
        part = texts.select("text", in_row.alias("hits")).where(F.size("hits") > 0)
        part = part.select(text_digest(F.col("text")).alias("digest"), "hits")
        part = part.select("digest", F.explode("hits").alias("hit"))
        found = part if found is None else found.unionByName(part)
    verified = found.join(lookup, F.col("hit.window") == F.col("window")).select(
        "digest",
        F.struct(
            F.col("hit.start").alias("start"),
            (F.col("hit.start") + F.col("hit.size")).alias("stop"),
        ).alias("span"),
        "items",
    )
    return verified.groupBy("digest").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _with_hits(docs: DataFrame, columns: list[Column], text: str, found: DataFrame) -> DataFrame:
    """``columns`` of the documents beside the hits of their texts."""
    left = docs.select(F.struct(*columns).alias("own"), text_digest(F.col(text)).alias("digest"))
    right = found.select("digest", F.struct("spans", "items").alias("hit"))
    return left.join(broadcast_measured(right), "digest", "left").select("own", "hit")


def report(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    **options: int,
) -> DataFrame:
    """Per document: ``key``, ``n_words``, ``spans`` (word places) and ``items``, empty where clean."""
    n_words = F.size(normal_words(F.col(text))).cast("bigint")
    columns = [F.col(key).alias("key"), n_words.alias("n_words")]
    found = hits(docs, benchmark, text, item_key, item_text, **options)
    joined = _with_hits(docs, columns, text, found)
    no_spans = F.array().cast("array<struct<start:int,stop:int>>")
    return joined.select(
        F.col("own.key").alias(key),
        F.col("own.n_words").alias("n_words"),
        F.coalesce("hit.spans", no_spans).alias("spans"),
        F.coalesce("hit.items", F.array().cast("array<string>")).alias("items"),
    )


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    **options: int,
) -> DataFrame:
    """The documents, all columns, with every hit passage cut out of their texts.

    A passage reaches from its first word to its last; what stands between
    passages and around them stays. Documents without hits are not touched.
    """
    found = hits(docs, benchmark, text, item_key, item_text, **options)
    joined = _with_hits(docs, [F.col(c) for c in docs.columns], text, found)

    def nothing(_: Column) -> Column:
        return F.lit("")

    def cut(spans: Column) -> Column:
        def places(words: Column) -> Column:
            as_chars = F.transform(
                spans,
                lambda s: F.struct(
                    F.get(words, s["start"])["start"].alias("start"),
                    F.get(words, s["stop"] - 1)["stop"].alias("stop"),
                ),
            )
            return let(tx.merged(as_chars), lambda m: tx.replaced(F.col(f"own.{text}"), m, nothing))

        return let(tx.spans_of(F.col(f"own.{text}"), WORD), places)

    cleaned = F.when(F.col("hit").isNotNull(), let(F.col("hit.spans"), cut)).otherwise(F.col(f"own.{text}"))
    return joined.select(
        *[cleaned.alias(c) if c == text else F.col(f"own.{c}").alias(c) for c in docs.columns]
    )


def remove_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    **options: int,
) -> DataFrame:
    """The documents without any hit, all columns."""
    found = hits(docs, benchmark, text, item_key, item_text, **options)
    joined = _with_hits(docs, [F.col(c) for c in docs.columns], text, found)
    return joined.where(F.col("hit").isNull()).select("own.*")

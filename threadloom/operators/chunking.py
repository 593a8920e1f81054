"""Greedy packing of sentences into chunks of bounded token count.

The packing is a fold over the sentences of one text, expressed as an array
aggregate: it runs inside the scan's stage, without a shuffle. The fold keeps
start positions and counts only; texts are cut out of the sentence array at
the end, so its state does not grow with the text, apart from one entry per
finished chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import dates, text
from threadloom.functions.strings import strip, words
from threadloom.functions.tokens import TokenCounter, estimate_counts
from threadloom.operators.filters import long_enough
from threadloom.sizing import spread

MIN_CHUNK_CHARS = 20

_SPANS = "array<struct<first:int,size:int,tokens:int>>"
_STATE = f"struct<done:{_SPANS},first:int,tokens:int,part:int,at:int>"


def sentences(c: Column) -> Column:
    """Pieces between full stops, stripped, blanks dropped, each ending in a stop."""
    kept = F.filter(F.transform(F.split(c, r"\."), strip), lambda s: s != "")
    return F.transform(kept, lambda s: F.concat(s, F.lit(".")))


def _probes(c: Column, limit: int) -> Column:
    """What is counted: per sentence itself, then its words if it may be too long.

    A text has no more tokens than bytes, so most sentences need no words, and
    one call counts everything.
    """

    def probe(s: Column) -> Column:
        each = F.transform(words(s), lambda w: F.concat(w, F.lit(" ")))
        none = F.array().cast("array<string>")
        return F.concat(F.array(s), F.when(F.octet_length(s) > limit, each).otherwise(none))

    return F.transform(sentences(c), probe)


def _units(limit: int) -> Column:
    """Sentences as packing units (text, tokens, part); one over the limit becomes
    its words.

    ``part`` is -1 for whole sentences and the sentence's number for words, so
    a change of part marks where a chunk must end.
    """

    def unit(text: Column, tokens: Column, part: Column) -> Column:
        return F.struct(text.alias("text"), tokens.alias("tokens"), part.alias("part"))

    def units(x: Column, i: Column) -> Column:
        probes, counts = x["_probes"], x["_counts"]
        rest = F.slice(F.arrays_zip(probes, counts), F.lit(2), F.size(probes))
        split = F.transform(
            rest, lambda p: unit(F.rtrim(p["_probes"]), p["_counts"], i)
        )
        first = F.get(counts, F.lit(0))
        whole = F.array(unit(F.get(probes, F.lit(0)), first, F.lit(-1)))
        return F.when(first > limit, split).otherwise(whole)

    # zipped, as an array looked up inside the lambda may be computed anew each time
    counted = F.arrays_zip(F.col("_probes"), F.col("_counts"))
    return F.flatten(F.transform(counted, units))


def _spans(limit: int) -> Column:
    """Fold of the units into chunk spans (first unit, number of units, tokens)."""
    empty = F.struct(
        F.array().cast(_SPANS).alias("done"),
        F.lit(0).alias("first"),
        F.lit(0).alias("tokens"),
        F.lit(-1).alias("part"),
        F.lit(0).alias("at"),
    ).cast(_STATE)

    def finished(state: Column) -> Column:
        span = F.struct(
            state["first"].alias("first"),
            (state["at"] - state["first"]).alias("size"),
            state["tokens"].alias("tokens"),
        )
        return F.concat(state["done"], F.array(span))

    def step(state: Column, unit: Column) -> Column:
        open_chunk = state["at"] > state["first"]
        over = (state["tokens"] + unit["tokens"] > limit) | (state["part"] != unit["part"])
        flush = open_chunk & over
        return F.struct(
            F.when(flush, finished(state)).otherwise(state["done"]).alias("done"),
            F.when(flush, state["at"]).otherwise(state["first"]).alias("first"),
            (F.when(flush, F.lit(0)).otherwise(state["tokens"]) + unit["tokens"]).alias("tokens"),
            unit["part"].alias("part"),
            (state["at"] + 1).alias("at"),
        )

    def last(state: Column) -> Column:
        return F.when(state["at"] > state["first"], finished(state)).otherwise(state["done"])

    return F.aggregate(F.col("_units"), empty, step, last)


def create_chunks(
    df: DataFrame, text_col: str, limit: int, counter: TokenCounter = estimate_counts
) -> DataFrame:
    """One row per chunk: ``seq``, ``text``, ``token_count`` replace the text column.

    A sentence over the limit is packed by words and shares no chunk with its
    neighbours; a word over the limit is a chunk of its own. Chunks of fewer
    than 20 characters are left out.
    """
    rest = [c for c in df.columns if c != text_col]

    def chunk_text(span: Column) -> Column:
        units = F.slice(F.col("_units"), span["first"] + 1, span["size"])
        return F.array_join(F.transform(units, lambda u: u["text"]), " ")

    chunks = F.filter(
        F.transform(
            F.col("_spans"),
            lambda s: F.struct(chunk_text(s).alias("text"), s["tokens"].alias("token_count")),
        ),
        lambda x: F.length(x["text"]) >= MIN_CHUNK_CHARS,
    )
    return (
        spread(df)
        .withColumn("_probes", _probes(F.col(text_col), limit))
        .withColumn("_counts", counter(F.col("_probes")))
        .withColumn("_units", _units(limit))
        .withColumn("_spans", _spans(limit))
        .select(*rest, F.posexplode(chunks).alias("seq", "_chunk"))
        .select(*rest, "seq", F.col("_chunk.text"), F.col("_chunk.token_count"))
    )


def chunk_posts(
    df: DataFrame,
    text_col: str = "text",
    thread_col: str = "thread_id",
    time_col: str = "posted_date_time",
    limit: int = 1000,
    counter: TokenCounter = estimate_counts,
) -> DataFrame:
    """Posts to valid chunks: wrap in time and thread, tidy, pack, keep the valid."""
    posted = F.col(time_col)
    if df.schema[time_col].dataType.typeName() != "string":
        posted = dates.time_text(posted)
    kept = long_enough(df, text_col, MIN_CHUNK_CHARS, trimmed=True)
    framed = text.temporal_wrap(F.col(text_col), posted, F.col(thread_col).cast("string"))
    tidy = kept.withColumn(text_col, text.clean_chunk_text(framed))
    chunks = create_chunks(tidy, text_col, limit, counter)
    return chunks.filter(text.is_valid_chunk(F.col("text")))

"""Many texts into one by a model that reads only so much at a time.

The texts of a group are packed, in order, into prompts of a bounded number of
tokens; the model's replies are the texts of the next level, until a group has
one prompt, whose reply is its result. Texts, and replies, longer than a quarter
of the limit are first cut at white space, so a prompt that is filled holds at
least three texts and every level is at most about a third of the one before.

Which prompt a text goes to follows from the tokens before it in its group: a
running sum within blocks of the order, and sums of the blocks before. No task
holds a group; only what fills one prompt meets in a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.strings import is_blank
from threadloom.functions.tokens import TokenCounter, estimate_counts
from threadloom.operators.chunking import _spans
from threadloom.operators.ordering import numbered
from threadloom.session import materialise

#: places of the order whose running sum is one window
BLOCK = 100_000
#: between the texts of a prompt; counted as one token
BETWEEN = "\n\n"

#: adds ``reply`` to prompts in ``text``; null where the call failed
Ask = Callable[[DataFrame], DataFrame]


def cut_texts(df: DataFrame, text_col: str, most: int, counter: TokenCounter = estimate_counts) -> DataFrame:
    """(..., ``piece``, text, ``tokens``): texts in pieces of at most ``most`` tokens, cut at white space.

    Only words of more than a quarter as many characters are cut inside. Pieces
    in order spell the text, without white space at its ends.
    """
    # a character has at most four bytes, and a byte is at most one token
    words = F.regexp_extract_all(F.trim(text_col), F.lit(rf"(\S{{1,{max(1, most // 4)}}}\s*)"), F.lit(1))
    split = df.withColumn("_words", words)
    split = split.withColumn("_counts", F.get(counter(F.array("_words")), F.lit(0)))

    def unit(z: Column) -> Column:
        # never less than a quarter of the characters: counts of words are rounded, and are to add up
        tokens = F.greatest(z["_counts"], F.ceil(F.length(z["_words"]) / 4).cast("int"))
        return F.struct(z["_words"].alias("text"), tokens.alias("tokens"), F.lit(-1).alias("part"))

    unit = F.transform(F.arrays_zip("_words", "_counts"), unit)
    spans = split.withColumn("_units", unit).withColumn("_spans", _spans(most))

    def piece(span: Column) -> Column:
        own = F.slice(F.col("_words"), span["first"] + 1, span["size"])
        return F.struct(F.rtrim(F.array_join(own, "")).alias("text"), span["tokens"].alias("tokens"))

    pieces = spans.withColumn("_pieces", F.transform("_spans", piece))
    rest = [c for c in df.columns if c != text_col]
    return pieces.select(*rest, F.posexplode("_pieces").alias("piece", "_p")).select(
        *rest, "piece", F.col("_p.text").alias(text_col), F.col("_p.tokens").alias("tokens")
    )


def pack_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int, most: int) -> DataFrame:
    """(by, ``prompt``, ``text``, ``parts``): texts of at most ``most`` tokens joined up to ``limit``, in order."""
    placed = numbered(df, [*by, *order]).withColumn("_block", F.floor(F.col("_place") / BLOCK))
    cost = F.col("tokens") + 1
    running = F.sum(cost).over(W.partitionBy(*by, "_block").orderBy("_place")) - cost
    blocks = placed.groupBy(*by, "_block").agg(F.sum(cost).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*by).orderBy("_block")) - F.col("_sum")
    blocks = blocks.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_b"), before.alias("_before"))
    same = [placed[c].eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_block") == F.col("_b")]
    narrow = placed.select(*by, "_block", "_place", "tokens", "text").withColumn("_running", running)
    begin = F.col("_before") + F.col("_running")
    # what begins before this many tokens ends within the limit
    numbered_prompts = narrow.join(blocks, same).withColumn("prompt", F.floor(begin / (limit - most)).cast("long"))
    texts = F.sort_array(F.collect_list(F.struct("_place", "text")))
    joined = F.array_join(F.transform(texts, lambda t: t["text"]), BETWEEN)
    return numbered_prompts.groupBy(*by, "prompt").agg(joined.alias("text"), F.count(F.lit(1)).alias("parts"))


def reduce_texts(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    text_col: str,
    ask: Ask,
    limit: int = 4000,
    counter: TokenCounter = estimate_counts,
) -> DataFrame:
    """(by, ``summary``, ``levels``, ``failed``): one text per group that has a non-blank one.

    Prompts whose call failed are left out of the next level and counted; the
    summary is null if the last one did. Each level is stored. A model whose
    replies leave as many texts as they read is an error.
    """
    most = (limit - 1) // 4 - 1
    if most < 4:
        raise ValueError(f"a limit of {limit} tokens is too small")
    own = df.filter(~is_blank(F.col(text_col))).select(*by, *order, F.col(text_col).alias("text"))
    parts = cut_texts(own, "text", most, counter)
    order, failed = [*order, "piece"], None
    done: DataFrame | None = None
    level, count = 0, None
    while True:
        level += 1
        prompts = materialise(pack_in_order(parts, by, order, limit, most))
        answers = materialise(ask(prompts))
        lost = answers.groupBy(*by).agg(F.sum(F.col("reply").isNull().cast("long")).alias("_lost"), F.count(F.lit(1)).alias("_prompts"))
        lost = lost if failed is None else _added(lost, failed, by)
        lost = materialise(lost)
        named = _beside(answers, lost, by)
        single = named.filter("_prompts = 1").select(
            *by, F.col("reply").alias("summary"), F.lit(level).alias("levels"), F.col("_lost").alias("failed")
        )
        done = single if done is None else done.unionByName(single)
        more = named.filter("_prompts > 1")
        left = more.count()
        if not left:
            return done
        if count is not None and left >= count:
            raise RuntimeError(f"{left} texts after level {level}, {count} before: the replies do not shrink")
        count, failed = left, lost.select(*by, F.col("_lost").alias("_earlier"))
        # a group whose every call failed ends here
        gone = more.groupBy(*by).agg(F.count("reply").alias("_got"), F.max("_lost").alias("failed")).filter("_got = 0")
        done = done.unionByName(
            gone.select(*by, F.lit(None).cast("string").alias("summary"), F.lit(level).alias("levels"), "failed")
        )
        replies = more.filter(~is_blank(F.col("reply"))).select(*by, "prompt", F.col("reply").alias("text"))
        parts, order = cut_texts(replies, "text", most, counter), ["prompt", "piece"]


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, a row per group; null is a group."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = [left[c].eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return left.join(named, same).drop(*[f"_r_{c}" for c in by])


def _added(lost: DataFrame, earlier: DataFrame, by: Sequence[str]) -> DataFrame:
    return _beside(lost, earlier, by).withColumn("_lost", F.col("_lost") + F.col("_earlier")).drop("_earlier")

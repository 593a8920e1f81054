"""Cleaning of whole text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.strings import chain, is_blank, let, squeeze, words
from threadloom.functions.text import CleanOptions
from threadloom.functions.unicode import fold_ascii
from threadloom.sizing import broadcast_measured, spread


def _folded(df: DataFrame, input_col: str) -> DataFrame:
    """Add ``_raw``, the text, and ``_folded``, with links cut and ASCII only."""
    raw = F.col(input_col).cast("string")
    linked = spread(df).withColumn("_raw", raw).withColumn("_linked", let(raw, text.links_to_hosts))
    return linked.withColumn("_folded", fold_ascii(F.col("_linked"))).drop("_linked")


def _normalized(
    options: CleanOptions, if_broken: Callable[[Column], Column] = lambda c: c
) -> Column:
    done = chain(F.col("_folded"), text.ascii_steps(options))
    broken = text.has_broken_link(F.col("_raw"))
    return F.when(broken, if_broken(F.col("_raw"))).otherwise(done)


def normalize(
    df: DataFrame, input_col: str, output_col: str, options: CleanOptions = CleanOptions()
) -> DataFrame:
    """Normalised text; a text with a malformed link stays as it was."""
    folded = _folded(df, input_col)
    return folded.withColumn(output_col, _normalized(options)).drop("_raw", "_folded")


def clean_corpus(
    df: DataFrame, input_col: str, clean_col: str, options: CleanOptions = CleanOptions()
) -> DataFrame:
    """Normalise, squeeze, pad if asked, and drop rows left blank.

    The blank rows go by exploding an array of at most one text. A filter would
    be pushed down to the scan and clean every text twice.
    """
    # normalised text has no white space left to squeeze, a broken one may
    normalized = _normalized(options, if_broken=squeeze)
    steps = [text.pad_punctuation] if options.padding else []
    folded = _folded(df, input_col)
    rest = [c for c in df.columns if c != clean_col]
    cleaned = F.array(chain(normalized, steps))
    kept = F.filter(cleaned, lambda x: ~is_blank(x))
    return folded.select(*rest, F.explode(kept).alias(clean_col))


def mask_words(
    df: DataFrame, text_col: str, key: str, lexicon: DataFrame, lexicon_col: str = "token"
) -> DataFrame:
    """Mask words of a lexicon table of any size.

    The distinct word pieces of each text are matched by a join; what matched
    comes back as one short array per text.
    """
    pieces = F.array_distinct(F.split(F.lower(F.col(text_col)), r"\W+"))
    flagged_words = lexicon.select(F.lower(F.col(lexicon_col)).alias("_piece")).distinct()
    matched = (
        df.select(F.col(key).alias("_key"), F.explode(pieces).alias("_piece"))
        .join(broadcast_measured(flagged_words), "_piece", "left_semi")
        .groupBy("_key")
        .agg(F.collect_set("_piece").alias("_flagged"))
    )
    masked = F.array_join(
        F.transform(words(F.col(text_col)), lambda w: text.mask_word(w, F.col("_flagged"))), " "
    )
    plain = F.array_join(words(F.col(text_col)), " ")
    return (
        df.join(matched, df[key].eqNullSafe(matched["_key"]), "left")
        .withColumn(text_col, F.when(F.col("_flagged").isNull(), plain).otherwise(masked))
        .drop("_key", "_flagged")
    )

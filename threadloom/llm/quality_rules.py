"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a ratio of counts over the whole text, every rule a pair of
bounds for one measure. The table is data; ``verdict`` turns it into a single
boolean expression, so no user function runs and a document is read once.

Defined results: null and blank texts have zero counts and fail for their
length; repeated rows are judged one by one, each like the other; other
columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.strings import let
from threadloom.llm import text as tx

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: fixed values: frequent function words of the languages that are served
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la que el en y los se del las un por con no una su para al lo como más pero "
    "le et les des du une est pour qui dans par sur pas plus au avec ce il sont"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure that must lie between two bounds, each of them allowed."""

    measure: str
    low: float | None = None
    high: float | None = None


#: the threshold table
RULES = (
    Rule("n_words", low=MIN_WORDS),
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbols_per_word", high=0.1),
    Rule("exclamations_per_word", high=0.25),
    Rule("upper_share", high=0.4),
    Rule("stop_word_share", low=0.02),
    Rule("repeat_share", high=MAX_REPEAT_PERCENT / 100),
    Rule("stutter_share", high=0.2),
    Rule("dup_line_share", high=0.5),
)


def repeat_words(words: Column) -> Column:
    """Words in 8-word windows that the text holds twice or more.

    Windows are compared by 64-bit hashes of their words. Only where a first
    look finds a hash twice are the windows sorted, so that equal ones meet.
    """

    def sorted_windows(win: Column) -> Column:
        placed = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]),
            )

        starts = F.array_sort(F.transform(let(placed, twice), lambda x: x["i"]))
        spans = F.transform(
            starts, lambda i: F.struct(i.alias("start"), (i + WINDOW).alias("stop"))
        )
        return tx.covered(spans)

    def count(win: Column) -> Column:
        several = F.size(F.array_distinct(win)) < F.size(win)
        return F.when(several, sorted_windows(win)).otherwise(F.lit(0).cast("bigint"))

    return let(
        let(tx.word_hashes(words), lambda h: tx.window_hashes(h, WINDOW)),
        count,
    )


def _count_of(text: Column, others: str) -> Column:
    """Characters left when all runs of ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("bigint")


def counts(text: Column) -> Column:
    """One struct of counts over a whole text; null counts as empty."""

    def lines_part(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        )

    def words_part(words: Column) -> Column:
        stops = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
        stutter = F.filter(words, lambda w, i: w == F.get(words, i - 1))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.size(stops).cast("bigint").alias("n_stop_words"),
            F.size(stutter).cast("bigint").alias("n_stutter"),
            repeat_words(words).alias("n_repeat_words"),
        )

    def all_parts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            let(tx.words_of(t), words_part).alias("words"),
            let(lines, lines_part).alias("lines"),
            _count_of(t, tx.BLANKS).alias("word_chars"),
            _count_of(t, r"[^#*$%&|<>]+").alias("n_symbols"),
            _count_of(t, "[^!]+").alias("n_exclamations"),
            _count_of(t, r"[^\p{Lu}]+").alias("n_upper"),
        )

    def flat(c: Column) -> Column:
        words = ("n_words", "n_stop_words", "n_stutter", "n_repeat_words")
        parts = [c["words"][n].alias(n) for n in words]
        parts += [c["lines"][n].alias(n) for n in ("n_lines", "n_dup_lines")]
        parts += [c[n].alias(n) for n in ("word_chars", "n_symbols", "n_exclamations", "n_upper")]
        return F.struct(*parts)

    return let(let(F.coalesce(text, F.lit("")), all_parts), flat)


def measures(c: Column) -> dict[str, Column]:
    """The ratios that rules may name, from a struct of counts."""

    def per(over: str, under: str) -> Column:
        return c[over] / F.greatest(c[under], F.lit(1))

    return {
        "n_words": c["n_words"],
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "exclamations_per_word": per("n_exclamations", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "stutter_share": per("n_stutter", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
    }


def base_failed(c: Column) -> Column:
    """Too short, or too much of it said twice (in whole numbers)."""
    return (c["n_words"] < MIN_WORDS) | (
        100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]
    )


def verdict(c: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one boolean expression: true where all of them hold."""
    known = measures(c)
    bounds = [known[r.measure] >= r.low for r in rules if r.low is not None]
    bounds += [known[r.measure] <= r.high for r in rules if r.high is not None]
    return reduce(Column.__and__, bounds, F.lit(True))


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Counts and verdict of every document: ``key``, counts, ``base_failed``, ``kept``."""
    c = F.col("c")
    counted = docs.select(F.col(key).alias("k"), counts(F.col(text)).alias("c"))
    names = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words n_stutter "
        "n_exclamations n_upper"
    ).split()
    return counted.select(
        F.col("k").alias(key),
        *[c[n].alias(n) for n in names],
        base_failed(c).alias("base_failed"),
        (~base_failed(c) & verdict(c, rules)).alias("kept"),
    )


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass all rules, with all their columns."""
    passed = let(counts(F.col(text)), lambda c: ~base_failed(c) & verdict(c, rules))
    return docs.where(passed)

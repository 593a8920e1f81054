"""Column expressions on whole texts that several operators share: words, spans, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.strings import let

#: what separates words, as fixed by the word definition ``[^\x20\x09-\x0D]+``
BLANKS = r"[\x20\x09-\x0D]+"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column, breaks: str = BLANKS) -> Column:
    """The non-empty pieces between ``breaks``; null text has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), breaks, -1)
    return F.filter(pieces, lambda w: w != "")


def indexes(first: int | Column, count: Column) -> Column:
    """``count`` integers from ``first``; none where ``count`` is not positive."""
    start = F.lit(first) if isinstance(first, int) else first
    none = F.array().cast("array<int>")
    return F.when(count > 0, F.sequence(start, (start + count - 1).cast("int"))).otherwise(none)


def window_hash(hashes: Column, i: Column, size: int) -> Column:
    """A 64-bit hash of ``size`` consecutive word hashes; equals ``xxhash64`` of their array."""
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])


def window_hashes(hashes: Column, size: int) -> Column:
    return F.transform(
        indexes(0, F.size(hashes) - (size - 1)), lambda i: window_hash(hashes, i, size)
    )


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def covered(spans: Column) -> Column:
    """How many places the spans (``start``, ``stop``, in the order of their starts) cover together."""
    zero = F.lit(0).cast("bigint")

    def step(s: Column, x: Column) -> Column:
        end = F.greatest(s["end"], x["stop"])
        new = end - F.greatest(s["end"], x["start"])
        return F.struct(
            (s["total"] + F.greatest(new, zero)).cast("bigint").alias("total"),
            end.cast("bigint").alias("end"),
        )

    state = F.struct(zero.alias("total"), zero.alias("end"))
    return F.aggregate(spans, state, step, lambda s: s["total"])


def merged(spans: Column) -> Column:
    """Overlapping or touching spans made one; ``spans`` in the order of their starts."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def span(start: Column, stop: Column) -> Column:
        return F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"))

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        apart = (F.size(done) == 0) | (x["start"] > last["stop"])
        grown = F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(span(last["start"], F.greatest(last["stop"], x["stop"]))),
        )
        return F.when(apart, F.concat(done, F.array(span(x["start"], x["stop"])))).otherwise(grown)

    return F.aggregate(spans, none, step)


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each of the disjoint ascending ``spans`` replaced by ``by(span)``.

    The text is taken apart once into code points, so the work is linear in its
    length; texts without spans are passed through.
    """

    def build(chars: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            start = F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0)).cast("int")
            return F.concat(_slice(chars, start, s["start"].cast("int")), F.array(by(s)))

        tail = F.get(spans, F.size(spans) - 1)["stop"].cast("int")
        parts = F.concat(F.flatten(F.transform(spans, part)), _slice(chars, tail, F.size(chars)))
        return F.array_join(parts, "")

    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(F.size(spans) > 0, let(chars, build)).otherwise(text)


def _slice(chars: Column, start: Column, stop: Column) -> Column:
    return F.slice(chars, start + 1, F.greatest(stop - start, F.lit(0)))


def running_sum(values: Column) -> Column:
    """Sums of the first 1, 2, 3, ... values.

    Doubling steps: n log n additions, where appending to a growing array would
    copy it for every value.
    """

    def double(acc: Column, j: Column) -> Column:
        shift = F.call_function("shiftleft", F.lit(1), j)
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - shift), F.lit(0).cast("bigint")))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int"))
    wide = F.transform(values, lambda x: x.cast("bigint"))
    return F.when(F.size(values) == 0, wide).otherwise(F.aggregate(rounds, wide, double))


def spans_of(text: Column, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, stop, match, before, after>>``.

    Places count code points from 0, ``stop`` is exclusive. The text between
    the matches gives the places: one pass extracts, one splits. ``before`` and
    ``after`` are up to ``context`` characters between a match and its
    neighbours. ``pattern`` must not match the empty string.
    """

    def place(found: Column) -> Column:
        def joined(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

            def span(ends: Column, m: Column, i: Column) -> Column:
                return F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.get(ends, i).alias("stop"),
                    m.alias("match"),
                    (F.right(F.get(gaps, i), F.lit(context)) if context else F.lit("")).alias("before"),
                    (F.left(F.get(gaps, i + 1), F.lit(context)) if context else F.lit("")).alias("after"),
                )

            return let(
                running_sum(steps),
                lambda ends: F.transform(found, lambda m, i: span(ends, m, i)),
            )

        gaps = F.split(text, pattern, -1)
        return F.when(F.size(found) > 0, let(gaps, joined)).otherwise(no_spans())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def no_spans() -> Column:
    return F.array().cast(
        "array<struct<start:bigint,stop:bigint,match:string,before:string,after:string>>"
    )


def spans_if(text: Column, hint: Column, pattern: str, keep=None, context: int = 0) -> Column:
    """Matches that ``keep`` accepts, sought only in texts that pass the cheap ``hint``."""
    found = spans_of(text, pattern, context)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["match"]))
    return F.when(hint, found).otherwise(no_spans())


def named(spans: Column, kind: str, rank: int) -> Column:
    """Spans as ``struct<start, rank, kind, stop>``, which sort by start, then rank."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            s["stop"].alias("stop"),
        ),
    )


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of every named span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )

"""Large CSV files read by several tasks, line breaks in fields and all.

A scan of text gives each task the lines that begin in its byte range. Whether
such a line begins inside a quoted field is not to be seen in the range alone,
but the quotes before it tell: inside if their number is odd. So one narrow pass
counts quotes by range, sums over the ranges of a file give the side on which
each begins, and a second pass cuts every range into records. What runs over the
end of a range is put together from its pieces, which are all that is shuffled.
Records become columns by Spark's own ``from_csv``.

Counting holds only for files whose quotes stand around fields. The first pass
looks at every line for other ones, for both sides, and for lines that end
unlike the file's first. ``regular_files`` names the files that can be cut; the
others are for the whole-file reader. Lines end with a line feed, with or
without a carriage return before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sizing import measure

#: quotes only around whole fields, for a line that begins outside or inside of one
OUTSIDE = r'^(?:(?:"(?:[^"]|"")*"|[^",]*),)*(?:"(?:[^"]|"")*"?|[^",]*)\r?$'
INSIDE = r'^(?:[^"]|"")*(?:"(?:,(?:"(?:[^"]|"")*"|[^",]*))*(?:,"(?:[^"]|"")*)?)?\r?$'

RANGES = (
    "path string, at bigint, quotes bigint, odd_outside bigint, odd_inside bigint, "
    "bare_outside bigint, bare_inside bigint, first_bare boolean, last_bare boolean"
)
PIECES = "path string, at bigint, whole boolean, opens boolean, record binary"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, at, line): lines with the start of the byte range they begin in."""
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("line"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Slices of a batch that lie in one range."""
    path, at = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    which = path.indices.to_numpy()
    if not len(at):
        return
    cuts = np.flatnonzero((at[1:] != at[:-1]) | (which[1:] != which[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(at)]):
        yield (path.dictionary[int(which[a])].as_py(), int(at[a])), batch.slice(a, b - a)


def _matches(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: quotes, and for both sides it may begin on, lines that break the rules."""
    name, held = None, None

    def row() -> pa.RecordBatch:
        names = [c.split()[0] for c in RANGES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*name, *held)], names=names)

    for batch in batches:
        for found, rows in _runs(batch):
            if found != name:
                if held:
                    yield row()
                name, held = found, [0, 0, 0, 0, 0, None, False]
            lines = rows.column(2)
            quotes = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False).astype("int64")
            after = held[0] + np.cumsum(quotes)
            begins, ends = (after - quotes) % 2 == 1, after % 2 == 1
            odd = [~_matches(lines, OUTSIDE), ~_matches(lines, INSIDE)]
            bare = ~_matches(lines, r"\r$")
            held[0] = int(after[-1])
            held[1] += int(np.where(begins, odd[1], odd[0]).sum())
            held[2] += int(np.where(begins, odd[0], odd[1]).sum())
            held[3] += int((bare & ~ends).sum())
            held[4] += int((bare & ends).sum())
            held[5] = bool(bare[0]) if held[5] is None else held[5]
            held[6] = bool(bare[-1])
    if held:
        yield row()


def scan_ranges(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, bool]:
    """(path, at, inside, odd, bare, last_bare) by range, stored, and whether that is small.

    ``inside``: the range begins in a quoted field. ``odd`` lines have quotes
    elsewhere than around fields, ``bare`` records end without a carriage return.
    """
    counted = _lines(spark, paths).mapInArrow(_counted, RANGES)
    # one row for each range of a file
    before = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    ranges = counted.withColumn("inside", inside).select(
        "path",
        "at",
        "inside",
        F.when(F.col("inside"), F.col("odd_inside")).otherwise(F.col("odd_outside")).alias("odd"),
        F.when(F.col("inside"), F.col("bare_inside")).otherwise(F.col("bare_outside")).alias("bare"),
        "first_bare",
        "last_bare",
        "quotes",
    )
    return measure(ranges)


def regular_files(ranges: DataFrame) -> DataFrame:
    """(path, returns) of files whose records all end alike and whose quotes stand around fields.

    ``returns``: the first line ends with a carriage return; then only the last
    record may lack it.
    """
    files = ranges.groupBy("path").agg(
        F.sum("odd").alias("odd"),
        F.sum("bare").alias("bare"),
        F.sum("quotes").alias("quotes"),
        (~F.min_by("first_bare", "at")).alias("returns"),
        F.max_by("last_bare", "at").cast("bigint").alias("last"),
    )
    good = (F.col("odd") == 0) & (F.col("quotes") % 2 == 0)
    return files.where(good & (~F.col("returns") | (F.col("bare") <= F.col("last")))).select("path", "returns")


def _cut(pieces: bool):
    """Task function: the whole records of each range, or the pieces that run over its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, inside, open_, head = None, False, [], False

        def out(records: pa.Array, whole: bool, opens: bool = False) -> Iterator[pa.RecordBatch]:
            n = len(records)
            if n and whole != pieces:
                columns = [pa.array([v] * n) for v in (name[0], name[1], whole, opens)]
                yield pa.RecordBatch.from_arrays([*columns, records], names=["path", "at", "whole", "opens", "record"])

        def close(ended: bool) -> Iterator[pa.RecordBatch]:
            """The record that is open goes out; one from an earlier range or with no end is a piece."""
            if open_:
                yield from out(pa.array([b"\n".join(open_)], pa.binary()), ended and not head, not head)
            open_.clear()

        for batch in batches:
            for found, rows in _runs(batch):
                if found != name:
                    yield from close(not inside)
                    (side,) = set(rows.column(3).slice(0, 1).to_pylist())
                    if side is None:
                        raise RuntimeError(f"other ranges of {found[0]} than before: read again")
                    name, inside, head = found, side, side
                    if found[1] == 0:  # the header
                        rows = rows.slice(1)
                        if not len(rows):
                            continue
                lines = rows.column(2)
                quotes = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False).astype("int64")
                after = int(inside) + np.cumsum(quotes)
                starts = np.flatnonzero((after - quotes) % 2 == 0)
                first = int(starts[0]) if len(starts) else len(lines)
                open_.extend(lines.slice(0, first).to_pylist())
                if len(starts):
                    yield from close(True)
                    head = False
                    last = int(starts[-1])
                    if len(starts) - 1 == last - first:  # a line each
                        whole = lines.slice(first, last - first)
                    else:
                        offsets = pa.array(starts - first, pa.int32())
                        lists = pa.ListArray.from_arrays(offsets, lines.slice(first, last - first))
                        whole = pc.binary_join(lists, b"\n")
                    yield from out(whole, True)
                    open_.extend(lines.slice(last).to_pylist())
                inside = bool(after[-1] % 2)
        yield from close(not inside)

    return run


def records(spark: SparkSession, paths: Sequence[str], ranges: DataFrame, small: bool) -> DataFrame:
    """(path, at, record): each record as bytes, without the line break that ends it.

    A record that runs over several ranges has the ``at`` of the one it begins in.
    """
    sides = ranges.select("path", "at", "inside")
    lines = _lines(spark, paths)
    if small:
        # a broadcast leaves the lines where and in the order in which they were read
        sided = lines.join(F.broadcast(sides), ["path", "at"], "left")
    else:
        sided = lines.withColumn("_line", F.monotonically_increasing_id()).join(sides, ["path", "at"], "left")
        sided = sided.repartition("path", "at").sortWithinPartitions("path", "at", "_line")
    sided = sided.select("path", "at", "line", "inside")
    whole = sided.mapInArrow(_cut(False), PIECES).select("path", "at", "record")
    parts = sided.mapInArrow(_cut(True), PIECES)
    # at most two pieces for each range
    order = W.partitionBy("path").orderBy("at", "opens")
    numbered = parts.withColumn("n", F.sum(F.col("opens").cast("int")).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("at", "opens", F.col("record").cast("string").alias("r"))))
    joined = numbered.groupBy("path", "n").agg(
        F.min("at").alias("at"), F.array_join(F.transform(pieces, lambda p: p["r"]), "\n").cast("binary").alias("record")
    )
    return whole.unionByName(joined.select("path", "at", "record"))


def rows_of(
    spark: SparkSession,
    paths: Sequence[str],
    header: Sequence[str],
    schema: T.StructType,
    returns: bool,
    ranges: DataFrame,
    small: bool,
) -> DataFrame:
    """Rows, and ``_file``, of regular files that begin with the same header, one line of theirs."""
    found = records(spark, paths, ranges, small)
    text = F.col("record").cast("string")
    if returns:
        # as the whole-file reader has breaks within fields
        text = F.replace(F.regexp_replace(text, "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    found = found.select("path", text.alias("text"))
    known = {f.name: f.dataType for f in schema.fields}
    quoted = [f"`{c.replace('`', '``')}` {known.get(c, T.StringType()).simpleString()}" for c in header]
    fields = F.from_csv("text", ", ".join(quoted), {"quote": '"', "escape": '"', "lineSep": "\n"})
    parsed = found.where("text <> ''").select(fields.alias("row"), F.col("path").alias("_file"))
    return parsed.select(*[F.col("row")[c].alias(c) for c in header], "_file")

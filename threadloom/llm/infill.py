"""Fill-in-the-middle by a piece table over immutable buffers.

A document's text is a buffer that is never copied while it is edited, the
sentinels are another. A document is a list of descriptors, each a buffer and a
range of it. Cutting splits descriptors at places, an arrangement permutes the
parts and puts sentinels between them, and the inverse permutation brings the
parts back. A digest streams the descriptors; the output is joined once, at the
end.

Where a document is cut, and into which form, comes from a digest of its seed
and key, so results don't depend on how rows are dealt out.

Defined results: a null text counts as empty, which stays plain, as a text that
holds a sentinel does. A null key is written as nothing into the digest. Rows
that repeat are each transformed alike. An empty table gives an empty result.
Restoring is exact for every form; a text in an arranged form that lacks its
sentinels is an error. Other columns pass through ``transform``, but one whose
name it gives itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values of the format
SENTINELS = ("<P>", "<S>", "<M>")
PREFIX, SUFFIX, MIDDLE = range(3)
#: parts of a document, named by their sentinels, in the order of each form
ARRANGEMENTS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN = "plain"

TEXT, MARKS = 0, 1
UNITS = {"line": rb"[^\n]*\n|[^\n]+", "char": rb"[\x00-\x7F\xC0-\xFF][\x80-\xBF]*"}

Descriptor = tuple[int, int, int]  # buffer, start, end


@dataclass(frozen=True)
class Rules:
    """How documents are cut: the unit, and percentages of arranged documents and of ``spm`` in them."""

    unit: str = "line"
    arranged: int = 100
    spm: int = 50
    seed: int = 7


class PieceTable:
    """Descriptors over a text and the sentinels; the buffers never change."""

    marks = "".join(SENTINELS).encode()
    mark_at = {i: (MARKS, 3 * i, 3 * i + 3) for i in range(3)}

    def __init__(self, text: bytes | memoryview):
        self.buffers = (memoryview(text), memoryview(self.marks))
        self.pieces: list[Descriptor] = [(TEXT, 0, len(text))]

    def cut(self, *places: int) -> list[list[Descriptor]]:
        """The descriptors parted at rising byte offsets of what they spell."""
        parts: list[list[Descriptor]] = [[]]
        wanted, at = list(places), 0
        for buffer, start, end in self.pieces:
            while wanted and wanted[0] <= at + end - start:
                middle = start + wanted.pop(0) - at
                parts[-1].append((buffer, start, middle))
                parts.append([])
                at, start = at + middle - start, middle
            parts[-1].append((buffer, start, end))
            at += end - start
        return parts

    def arrange(self, parts: list[list[Descriptor]], form: str) -> None:
        """Parts prefix, suffix, middle in the order of a form, each behind its sentinel."""
        self.pieces = [d for name in ARRANGEMENTS[form] for d in (self.mark_at[name], *parts[name])]

    def restore(self, form: str) -> None:
        """The inverse: parts behind the sentinels of the text back in their first order."""
        (text,) = self.buffers[:1]
        spelled, ends, at = bytes(text), [], 0
        for name in ARRANGEMENTS[form]:
            mark = SENTINELS[name].encode()
            at = spelled.find(mark, at)
            if at < 0 or (not ends and at):
                raise ValueError(f"no {SENTINELS[name]} where form {form} has it")
            ends.append(at)
            at += len(mark)
        parts = dict(zip(ARRANGEMENTS[form], zip(ends, [*ends[1:], len(spelled)])))
        self.pieces = [(TEXT, parts[n][0] + 3, parts[n][1]) for n in (PREFIX, MIDDLE, SUFFIX)]

    def spans(self) -> Iterator[memoryview]:
        return (self.buffers[b][i:j] for b, i, j in self.pieces)

    def digest(self) -> str:
        streamed = hashlib.sha256()
        for span in self.spans():
            streamed.update(span)
        return streamed.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.spans())


def _chars(raw: bytes) -> int:
    return len(raw.decode())


def transform_one(text: bytes, key: str, rules: Rules = Rules()) -> tuple:
    """``n, form, prefix_chars, middle_chars, output, digest`` of one text in UTF-8."""
    table = PieceTable(text)
    ends = [m.end() for m in re.finditer(UNITS[rules.unit], text)]
    n = len(ends)
    drawn = hashlib.sha256(f"{rules.seed}:{key}".encode()).hexdigest()
    a, b, c, d = (int(drawn[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s.encode() in text for s in SENTINELS) or c % 100 >= rules.arranged:
        return n, PLAIN, None, None, text, table.digest()
    form = "spm" if d % 100 < rules.spm else "psm"
    first, second = (([0] + ends)[i] for i in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = table.cut(first, second)
    table.arrange([prefix, suffix, middle], form)
    return n, form, _chars(text[:first]), _chars(text[first:second]), table.text(), table.digest()


def restore_one(output: bytes, form: str) -> tuple[bytes, str]:
    """The exact text of an output and its digest."""
    table = PieceTable(output)
    if form != PLAIN:
        table.restore(form)
    return table.text(), table.digest()


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars``, the text ``output`` and its ``output_sha256``."""
    kind = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"

    @F.arrow_udf(kind)
    def of(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [transform_one(_raw(t), k.as_py() or "", rules) for k, t in zip(keys, texts)]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[4] = arrays[4].cast(pa.string())
        names = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
        return pa.StructArray.from_arrays(arrays, names=names)

    names = [f.name for f in T._parse_datatype_string(kind).fields]
    rest = [c for c in docs.columns if c.lower() not in names]
    made = F.struct(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    rows = docs.select(F.struct(*rest).alias("own"), made.alias("made"))
    rows = rows.select("own", of("made.k", "made.t").alias("m"))
    return rows.select(*[F.col("own")[c].alias(c) for c in rest], "m.*")


def restore(output: Column, form: Column) -> Column:
    """``text`` and ``sha256`` rebuilt from an output and its form."""

    @F.arrow_udf("text string, sha256 string")
    def of(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        rows = [restore_one(_raw(o), f.as_py()) for o, f in zip(outputs, forms)]
        texts = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([texts, pa.array([r[1] for r in rows], pa.string())], names=["text", "sha256"])

    return of(output, form)

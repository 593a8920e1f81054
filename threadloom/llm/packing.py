"""Best-fit packing by patterns: non-negative least squares over a length histogram.

Documents become token ids with a closing id each; what is longer than a
sequence is cut into full pieces. Only the histogram of piece lengths, at most
``capacity`` numbers, reaches the driver. There, patterns of one to three
lengths that fill a sequence are enumerated, their repeat counts fitted to the
histogram by non-negative least squares and rounded, and the pieces left over
are packed best-fit decreasing, also by counts. The plan is a table of ranges:
"pieces of this length with these ranks go to those sequences at this offset".

Pieces get their rank within their length from a count per task and a running
sum over tasks, so no length, however common, is sorted or gathered in one
place, and each piece looks its sequence up by binary search.

Defined results: null and empty texts are one closing id; repeated rows and
null keys are packed like any other; other columns are not read; an empty table
gives an empty result. Special tokens spelled out in a text are taken as the
tokenizer takes them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.tables import stored

CAPACITY = 2048
CLOSING_ID = 0
#: words and stems, and ids of theirs, that a worker keeps
KEPT_WORDS = 300_000
KEPT_IDS = 3_000_000
#: rows of pieces handed on at a time
ROWS = 4096
#: bytes of texts encoded at a time; longer ones are encoded in parts
SLICE_BYTES = 2 << 20
#: stems put into one line, and words and stems taught at a time: the tokenizer's answers are large
LINE = 100
TAUGHT = 5000

Encoder = Callable[[pa.Array], list[bytes]]

#: letters of a stem, and punctuation that may follow it; an apostrophe may begin a piece of its own
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
MARKS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
PLAIN_WORD = f"^(?P<stem>[{LETTERS}]+)(?P<mark>[{MARKS}]*)$"


class _Pool:
    """Token ids of many words, one after the other, each found by its row."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.start, self.length = np.zeros(1 << 12, dtype="int64"), np.zeros(1 << 12, dtype="int64")
        self.used = 0

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.rows), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.start):
            self.start, self.length = (np.concatenate([c, np.zeros_like(c)]) for c in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.used += len(ids)
        self.rows.update(zip(words, range(first, first + n)))

    def spelled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in order, and where each row's end."""
        lengths = self.length[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[rows] - ends + lengths, lengths) + np.arange(total)], ends


def _parts(text: str) -> list[str]:
    """A text in parts of bounded length, cut at spaces; a longer word stays whole."""
    parts, at = [], 0
    while len(text) - at > SLICE_BYTES:
        cut = text.find(" ", at + SLICE_BYTES)
        if cut < 0:
            break
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def word_encoder(path: str) -> Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, word by word.

    For tokenizers in lower case whose rules never look across white space and
    take runs of letters and runs of punctuation as pieces of their own. A space
    or line break then ends a word for certain, and a word or stem met before
    need not be encoded again. New stems go through the tokenizer by the line;
    its word-end mark tells them apart. Any other word is encoded by itself.
    Words are told apart, and their ids put together, by columns.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        ends[i] = token.endswith("</w>")
    pool = _Pool()

    def learn_stems(fresh: list[str]) -> None:
        lines = [" ".join(fresh[at : at + LINE]) for at in range(0, len(fresh), LINE)]
        found = [e.ids for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), dtype="<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(fresh):
            raise ValueError("a stem was not encoded as one piece")
        pool.add(fresh, ids, np.diff(stops, prepend=0))

    def learn_others(fresh: list[str]) -> None:
        found = [e.ids for e in tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        lengths = np.array([len(ids) for ids in found], dtype="int64")
        pool.add(fresh, np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(lengths.sum())), lengths)

    def rows_of(words: pa.Array, learn: Callable[[list[str]], None]) -> np.ndarray:
        """Rows of words, each distinct one looked up once."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [w for w in distinct if w not in pool.rows]
        for at in range(0, len(fresh), TAUGHT):
            learn(fresh[at : at + TAUGHT])
        rows = np.fromiter(map(pool.rows.__getitem__, distinct), dtype="int64", count=len(distinct))
        return rows[coded.indices.to_numpy()]

    def encode(texts: pa.Array) -> list[bytes]:
        if len(pool.rows) > KEPT_WORDS or pool.used > KEPT_IDS:
            pool.__init__()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        found = pc.extract_regex(words, PLAIN_WORD)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        stem, mark = np.zeros(len(words), dtype="int64"), np.zeros(len(words), dtype="int64")
        parts = found.filter(pa.array(plain))
        stem[plain] = rows_of(pc.utf8_lower(parts.field("stem")), learn_stems)
        mark[plain] = rows_of(parts.field("mark"), learn_others)
        stem[~plain] = rows_of(words.filter(pa.array(~plain)), learn_others)
        which = coded.indices.to_numpy()
        ids, stops = pool.spelled(np.stack([stem[which], mark[which]], axis=1).ravel())
        # two rows for each word
        bounds = np.concatenate([[0], stops])[2 * split.offsets.to_numpy()]
        raw, at = ids.tobytes(), (4 * bounds).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:])]

    return encode


def _encoded(texts: pa.Array, encode: Encoder) -> Iterator[tuple[int, bytes]]:
    """(place, ids) of each text, some megabytes at a time; a null text is empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    first = 0
    while first < len(texts):
        many = int(np.searchsorted(np.cumsum(sizes[first:]), SLICE_BYTES, side="right"))
        if many:
            rows = pc.fill_null(texts.slice(first, many), "")
            yield from enumerate(encode(rows), first)
        else:
            many = 1
            parts = _parts(texts[first].as_py())
            yield first, b"".join(encode(pa.array([p], pa.large_string()))[0] for p in parts)
        first += many


def pieces(
    docs: DataFrame,
    load: Callable[[], Encoder],
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``part, rank``.

    ``rank`` numbers the pieces of one length within one task, ``part`` is the task.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = own.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("rank", T.LongType()),
        ]
    )
    closing = int(CLOSING_ID).to_bytes(4, "little")

    def rows(batch: pa.RecordBatch, taken: list[int], out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken)), *columns], names=schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        encode = None
        for batch in batches:
            encode = encode or load()
            taken, out = [], []
            for i, ids in _encoded(batch.column(1), encode):
                ids += closing
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    taken.append(i)
                    out.append((piece, at // 4, length, zlib.crc32(own), part, rank))
                if len(out) >= ROWS:
                    yield rows(batch, taken, out)
                    taken, out = [], []
            if out:
                yield rows(batch, taken, out)

    return own.mapInArrow(cut, schema)


@dataclass
class Plan:
    """Ranges of ranks per length, in the order of length and rank.

    A piece of ``length[e]`` whose rank lies ``t`` past ``rank[e]`` goes to
    sequence ``sequence[e] + t // repeat[e]`` at ``offset[e] + t % repeat[e] * length[e]``.
    """

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    repeat: np.ndarray
    offset: np.ndarray
    n_sequences: int


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows ``i <= j <= k`` of places in ``lengths`` (one past the end: none) that fill best.

    One or two lengths are completed by the greatest length that still fits,
    which for a dense histogram fills the sequence exactly.
    """
    n = len(lengths)
    at = np.searchsorted(lengths, np.arange(capacity + 1), side="right") - 1  # greatest that fits
    singles = np.full((n, 3), n)
    singles[:, 0] = np.arange(n)
    i, j = np.triu_indices(n)
    room = capacity - lengths[i] - lengths[j]
    fits = room >= 0
    i, j, room = i[fits], j[fits], room[fits]
    k = at[room]
    triple = k >= j
    pairs = np.stack([np.arange(n), at[capacity - lengths], np.full(n, n)], axis=1)
    pairs = pairs[pairs[:, 1] >= pairs[:, 0]]
    return np.concatenate([singles, pairs, np.stack([i, j, k], axis=1)[triple]])


def fit_counts(lengths: np.ndarray, counts: np.ndarray, pats: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Non-negative repeat counts of patterns, least squares against the histogram.

    Multiplicative updates keep the counts non-negative and each lowers the
    error, which is weighted by length: a long piece left over costs more.
    """
    n = len(lengths)
    weight = np.append(lengths / lengths.max(), 0.0)
    target = np.append(counts, 0).astype(float) * weight
    pull = target[pats].sum(axis=1)
    x = np.full(len(pats), counts.sum() / (2.0 * len(pats)))
    for _ in range(rounds):
        made = np.zeros(n + 1)
        for column in range(3):
            made += np.bincount(pats[:, column], weights=x, minlength=n + 1)
        x *= pull / np.maximum((weight * made)[pats].sum(axis=1), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences for a histogram of piece lengths, each between 1 and ``capacity``."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(v)] for v in lengths], dtype=np.int64)
    entries: list[tuple[int, int, int, int, int]] = []  # place, first sequence, count, repeat, offset
    n_sequences = 0
    if len(lengths):
        pats = patterns(lengths, capacity)
        # what a pattern wastes is the rest packing's to fill
        full = np.append(lengths, 0)[pats].sum(axis=1) == capacity
        pats = pats[full]
        if len(pats):
            x = fit_counts(lengths, left, pats)
            # rounding that carries what it cuts on to the next pattern
            sums = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
            rounded = np.diff(sums, prepend=0)
            n = len(lengths)
            for p in np.argsort(-rounded, kind="stable"):
                want = int(rounded[p])
                if want == 0:
                    break
                members = [int(m) for m in pats[p] if m < n]
                repeat = {m: members.count(m) for m in members}
                count = min(want, *(int(left[m]) // r for m, r in repeat.items()))
                if count <= 0:
                    continue
                offset = 0
                for m, r in repeat.items():
                    entries.append((m, n_sequences, count, r, offset))
                    offset += r * int(lengths[m])
                    left[m] -= r * count
                n_sequences += count
    n_sequences = _pack_rest(lengths, left, capacity, n_sequences, entries)
    return _as_plan(lengths, entries, n_sequences)


def _pack_rest(lengths, left, capacity: int, n_sequences: int, entries: list) -> int:
    """Best-fit decreasing by counts: like bins are one group and are filled together."""
    groups: dict[int, list[tuple[int, list]]] = {}  # free room: (count, [(place, repeat), ...])

    def add(room: int, count: int, held: list) -> None:
        groups.setdefault(room, []).append((count, held))

    for place in range(len(lengths) - 1, -1, -1):
        length, n = int(lengths[place]), int(left[place])
        for room in sorted(r for r in groups if r >= length):
            waiting = groups.pop(room) if n else []
            while waiting and n:
                count, held = waiting.pop()
                each = room // length
                filled = min(count, n // each)
                if filled:
                    add(room - each * length, filled, [*held, (place, each)])
                    n -= filled * each
                if filled < count and n:  # fewer than one bin takes
                    add(room - n * length, 1, [*held, (place, n)])
                    filled, n = filled + 1, 0
                if filled < count:
                    waiting.append((count - filled, held))
            if waiting:
                groups.setdefault(room, []).extend(waiting)
            if not n:
                break
        if n:
            each = capacity // length
            if n // each:
                add(capacity - each * length, n // each, [(place, each)])
            if n % each:
                add(capacity - (n % each) * length, 1, [(place, n % each)])
    for waiting in groups.values():
        for count, held in waiting:
            offset = 0
            for place, each in held:
                entries.append((place, n_sequences, count, each, offset))
                offset += each * int(lengths[place])
            n_sequences += count
    return n_sequences


def _as_plan(lengths: np.ndarray, entries: list, n_sequences: int) -> Plan:
    entries.sort()
    table = np.array(entries, dtype=np.int64).reshape(-1, 5)
    taken = table[:, 2] * table[:, 3]
    ends = np.cumsum(taken)
    starts = ends - taken
    place = table[:, 0]
    first = np.searchsorted(place, place, side="left")
    rank = starts - starts[first] if len(place) else starts
    return Plan(lengths[place] if len(place) else place, rank, table[:, 1], table[:, 3], table[:, 4], n_sequences)


def pack(
    docs: DataFrame,
    load: Callable[[], Encoder],
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = stored(pieces(docs, load, key, text, capacity), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    p = plan(histogram, capacity)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        wide = np.int64(1) << 40
        keys = p.length * wide + p.rank
        at = np.searchsorted(keys, length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        t = rank.to_numpy() - p.rank[at]
        return pd.DataFrame(
            {
                "sequence_id": p.sequence[at] + t // p.repeat[at],
                "offset": p.offset[at] + t % p.repeat[at] * p.length[at],
            }
        )

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select(
        F.col("key").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.col("at.sequence_id").alias("sequence_id"),
        F.col("at.offset").alias("offset"),
    )

"""Near-duplicates, components, shards and packed sequences against brute force."""

from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, prose, with_clashes
from threadloom.llm import packing, sharding, simhash
from threadloom.llm.components import components
from threadloom.llm.packing_queries import TOKENIZER, encoder, tokenizer_path

SF_DIR = "/root/testdata/sf0.01"


def fingerprint_by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return "0" * 16
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return f"{bits:016x}"


def groups_by_hand(rows):
    """``rows`` of (id, fingerprint): the least id of each row's component, by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f, least.get(root(f))) for i, f in rows]


def key(rows):
    return sorted(map(str, rows))


def test_near_duplicates_of_all_documents(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = groups_by_hand([(r["doc_id"], fingerprint_by_hand(r["text"])) for r in df.collect()])
    got = simhash.duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert key(tuple(r) for r in got) == key(want)
    assert len({c for _, _, c in want}) < len(want)


def test_near_duplicates_of_odd_rows(spark):
    base = prose(1, 200)
    texts = [(3, None), (4, ""), (2, " \n"), (None, base), (9, base), (9, base), (8, base.upper()), (None, "alone here"), (None, "alone here"), (1, "y" * 100_000)]
    texts += [(100 + n, base + f" tail{n}") for n in range(30)]
    df = with_clashes(documents(spark, texts))
    want = groups_by_hand([(i, fingerprint_by_hand(t)) for i, t in texts])
    assert key(tuple(r) for r in simhash.duplicates(df).collect()) == key(want)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    groups = {}
    for (i, t), (_, f, c) in zip(texts, want):
        groups.setdefault((c, f if c is None else ""), []).append(i)
    assert kept.count() == len(groups)
    assert key(r["doc_id"] for r in kept.collect()) == key(c for c, _ in groups)
    assert simhash.duplicates(empty(spark)).count() == 0 and simhash.keep_first(empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [2, 5, 8192])
def test_links_connect_what_all_pairs_connect(spark, crowd):
    """Crowded keys, chains and strangers; a low crowd sends most of them the other way."""
    rng = random.Random(crowd)

    def turned(f, n):
        for b in rng.sample(range(64), n):
            f ^= 1 << b
        return f

    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1, *centres}
    fps |= {turned(c, rng.randint(1, 4)) for c in centres for _ in range(40)}
    chain = rng.getrandbits(64)
    for _ in range(20):
        chain = turned(chain, 4)
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(df, crowd)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    by_hand = groups_by_hand([(f, f"{f & (1 << 64) - 1:016x}") for f, in signed])
    assert {f: got.get(f, f) for f, in signed} == {f: c for f, _, c in by_hand}


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, n) for n in range(1001, 1400)] + [(5000, 5000), (7, 3), (3, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{n: 0 for n in range(1, 201)}, **{n: 1000 for n in range(1001, 1400)}}
    assert components(df.where("false")).count() == 0


def test_fingerprint_in_blocks(monkeypatch):
    text = prose(9, 5000)
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "BLOCK", 37)
    assert simhash.fingerprint_of(text) == whole
    assert f"{whole & (1 << 64) - 1:016x}" == fingerprint_by_hand(text)


def shards_hold(rows, limit):
    sizes, docs = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
        docs[r["shard"]] = docs.get(r["shard"], 0) + 1
    for r in rows:
        assert sizes[r["shard"]] == r["shard_bytes"] and docs[r["shard"]] == r["shard_docs"]
        assert r["shard_bytes"] <= limit or r["shard_docs"] == 1
    plain = sorted(s for s in sizes if "-" not in s)
    # no bucket lies within another
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:]))
    return sizes


def test_shards_keep_their_limit(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = sharding.assign(df, 100_000).collect()
    assert len(rows) == df.count()
    sizes = shards_hold(rows, 100_000)
    assert len(sizes) > 20
    # a bucket splits only if it must: with its sibling's documents it would not fit
    for s in sizes:
        if s and "-" not in s:
            parent = sum(n for t, n in sizes.items() if t.startswith(s[:-1]))
            assert parent > 100_000


def test_shards_of_one_key_with_most_rows(spark):
    texts = [(7, "x" * 100)] * 300 + [(7, "y" * 5000), (None, None), (None, "z" * 40), (1, "")] + [(n, "w" * 90) for n in range(100, 160)]
    df = with_clashes(documents(spark, texts).repartition(5))
    rows = sharding.assign(df, 1000).collect()
    assert len(rows) == len(texts)
    sizes = shards_hold(rows, 1000)
    assert max(v for k, v in sizes.items()) == 5000
    assert sharding.assign(empty(spark), 1000).count() == 0


def test_shards_of_documents_above_the_limit(spark):
    """Each is a shard of its own: without a key, or with the same one."""
    texts = [(None, "a" * 50), (None, "b" * 60), (5, "c" * 40), (5, "d" * 45), (5, "d" * 45), (6, "e" * 90), (None, "f" * 3), (5, "g" * 3)]
    rows = sharding.assign(documents(spark, texts).repartition(3), 30).collect()
    assert len(rows) == len(texts)
    sizes = shards_hold(rows, 30)
    alone = [r for r in rows if r["n_bytes"] > 30]
    assert len({r["shard"] for r in alone}) == len(alone) == 6
    assert all(r["shard_docs"] == 1 and r["shard_bytes"] == r["n_bytes"] for r in alone) and None not in sizes


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def encode(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def packed_holds(rows, texts, capacity=2048):
    """Every document comes back whole, and no sequence has gaps, overlaps or too much."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for i, t in texts:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want.append((i, piece, start, len(own), zlib.crc32(own.tobytes())))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert key(tuple(r[n] for n in names) for r in rows) == key(want)
    return len(by_sequence)


def test_packing_round_trip(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = packing.pack(df, encoder(tokenizer_path())).collect()
    n = packed_holds(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_of_odd_rows(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "hello"), (3, "x" * 30_000), (4, "word " * 9000), (5, "ÁB İ ﬁ é 　 \x1c\x85 '’s it's <|endoftext|>x <|startoftext|>"), (6, "\n \t\r\x0b")]
    texts += [(10 + n, prose(n, 50 * n)) for n in range(30)]
    df = with_clashes(documents(spark, texts).repartition(4))
    packed_holds(packing.pack(df, encoder(tokenizer_path())).collect(), texts)
    assert packing.pack(empty(spark), encoder(tokenizer_path())).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = [2048, 100, 64][seed % 3]
    lengths = np.clip(rng.lognormal(np.log(capacity / 6), 1, 2000), 1, capacity).astype(int)
    histogram = {int(v): int(n) for v, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan(histogram, capacity)
    fill = np.zeros(plan.n_sequences, dtype=int)
    for v, n in histogram.items():
        own = np.flatnonzero(plan.length == v)
        ranks = np.arange(n)
        at = own[np.searchsorted(plan.rank[own], ranks, side="right") - 1]
        np.add.at(fill, plan.sequence[at] + (ranks - plan.rank[at]) // plan.repeat[at], v)
    assert fill.max() <= capacity and fill.min() > 0
    assert plan.n_sequences <= 1.02 * lengths.sum() / capacity + 2


def encoded(load, texts):
    return [np.frombuffer(b, dtype="<u4").tolist() for _, b in packing._encoded(pa.array(texts, pa.string()), load)]


def test_kept_words_stay_bounded(monkeypatch):
    load = packing.word_encoder(tokenizer_path())
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    monkeypatch.setattr(packing, "LINE", 2)
    texts = ["one two three four five", None, "five six seven", "one " + "long" * 30]
    for _ in range(3):
        assert encoded(load, texts) == [encode(t or "") for t in texts]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    load = packing.word_encoder(tokenizer_path())
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    texts = [prose(1, 200), "", "one two", "x" * 500, prose(2, 4), "y" * 60 + " z", " " * 300]
    assert encoded(load, texts) == [encode(t) for t in texts]


def test_odd_characters_get_the_tokenizers_ids():
    load = packing.word_encoder(tokenizer_path())
    rng = random.Random(8)
    signs = list("abcdzABZ  \n\t\r\x0b\x0c.,'!\"<|>[]\\-^0159éÉßÿµªº×÷éİŉдж\xa0\u2028\x00\x1c\x85🙂ﬁⅧ²ǅK\u0301\u0308")
    signs += ["'s", "'t", "'ll", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(8000)]
    assert encoded(load, texts) == [e.ids for e in tokenizer().encode_batch_fast(texts, add_special_tokens=False)]

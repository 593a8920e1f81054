"""The pipeline's stages, one after the other, against plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import documents, empty, prose
from tests.llm.test_groups_and_packs import fingerprint_by_hand, groups_by_hand, key, packed_holds
from tests.llm.test_rules_and_spans import BREAKS, hits_by_hand, lower, rules_by_hand, words

BENCH = [(1, prose(50, 30)), (2, prose(51, 12)), (3, None)]
LONG = prose(7, 400)
ROWS = (
    [(n, prose(100 + n, 150 + n)) for n in range(20)]
    # copies, of the same key as well, and near copies: a word more at the end
    + [(30, LONG), (31, LONG), (31, LONG), (None, LONG), (32, LONG.replace("w", "W", 50)), (33, LONG + " more")]
    + [(40, prose(8, 100) + " " + prose(50, 30) + " " + prose(9, 100)), (41, prose(10, 60) + " " + prose(51, 12).upper() + " " + prose(11, 60))]
    + [(50, prose(12, 80) + " write to jo.doe@example.org, from 10.0.0.7 " + prose(13, 80))]
    # rejected: too short, empty, null, one phrase over and over
    + [(60, "too short"), (61, ""), (62, None), (63, "the same few words of this phrase again " * 40)]
)


def passages_cut(text):
    """The text without its hit words, each passage from its first to its last word."""
    found = [(m.start(), m.end()) for m in re.finditer(BREAKS.replace("[", "[^", 1), lower(text))]
    w = words(lower(text), BREAKS)
    hit = set()
    for _, t in BENCH:
        b = words(lower(t), BREAKS)
        wins = {tuple(b[i : i + 10]) for i in range(len(b) - 9)}
        for i in range(len(w) - 9):
            if tuple(w[i : i + 10]) in wins:
                hit |= set(range(i, i + 10))
    out, at, i = [], 0, 0
    while i < len(w):
        if i not in hit:
            i += 1
            continue
        j = i
        while j + 1 in hit:
            j += 1
        out.append(text[at : found[i][0]])
        at, i = found[j][1], j + 1
    return "".join(out) + text[at:]


@pytest.fixture
def folder(spark, tmp_path):
    documents(spark, ROWS).withColumn("more", F.lit("x")).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def after_stages(spark, folder):
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found[name] = docs
    return found


def pairs(df):
    return key((r["doc_id"], r["text"]) for r in df.collect())


def test_all_stages_by_hand(spark, folder):
    found = after_stages(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(found)
    want = [(i, t) for i, t in ROWS if not rules_by_hand(t)[-1]]
    assert {i for i, _ in ROWS} - {i for i, _ in want} == {60, 61, 62, 63}
    assert pairs(found["quality_rules"]) == key(want)

    # one row of each group: that of the least key
    groups = groups_by_hand([(i, fingerprint_by_hand(t)) for i, t in want])
    first = {c for _, _, c in groups}
    want = list({(i, t): None for (i, t), (_, _, c) in zip(want, groups) if i == c})
    assert 30 in first and not first & {31, 32, 33, None}
    assert pairs(found["near_duplicates"]) == key(want)

    want = [(i, passages_cut(t)) for i, t in want]
    assert all(hits_by_hand(t, BENCH)[1] == 0 for _, t in want)
    assert pairs(found["decontaminate"]) == key(want)

    want = [(i, re.sub(r"jo\.doe@example\.org|10\.0\.0\.7", "[redacted]", t)) for i, t in want]
    assert pairs(found["pii"]) == key(want)
    for name in list(found)[:-1]:
        assert found[name].columns == ["doc_id", "text", "lang", "source", "n_chars", "more"]
        assert all(r["n_chars"] == len(r["text"]) and r["more"] == "x" for r in found[name].collect())

    rows = found["packing"].collect()
    assert packed_holds(rows, want) <= 1.01 * -(-sum(r["length"] for r in rows) // 2048) + 1
    # a run in one go gives the same pieces
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, folder).select(*names).collect()
    assert key(tuple(r) for r in whole) == key(tuple(r[n] for n in names) for r in rows)


def test_an_empty_table_gives_no_sequences(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Fill-in-the-middle: exact round trips and a plain version of the contract."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASHING, documents, empty, prose, with_clashes
from threadloom.llm import infill
from threadloom.llm.infill import PieceTable, Rules, restore_one, transform_one
from threadloom.llm.vector_queries import op12_infill

SF_DIR = "/root/testdata/sf0.01"


def by_hand(key, text):
    """Form, prefix, middle and output, by strings alone."""
    text = text or ""
    lines = [s + "\n" for s in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    drawn = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_query_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = sorted((r["doc_id"], *by_hand(r["doc_id"], r["text"])[:4], sha(by_hand(r["doc_id"], r["text"])[4]), sha(r["text"])) for r in docs)
    assert sorted(tuple(r) for r in op12_infill(spark, SF_DIR).collect()) == want
    assert {r[2] for r in want} >= {"psm", "spm"}


def test_odd_rows(spark):
    odd = [None, "", "\n", "\n\n\n", "no end", "a\r\nb\nc", "ünï\n日本\n🙂🙂", "has <P> in it\nx", "<S>", "<M\n>P<\nM>", "\0\n\0", "x" * 300_000, prose(1, 50) + "\n" + prose(2, 40)]
    texts = [(n, t) for n, t in enumerate(odd)] + [(None, "one\ntwo\nthree"), (None, "one\ntwo\nthree"), (0, "again\nand again")]
    df = with_clashes(documents(spark, texts)).withColumns({"form": F.lit("clash"), "N": F.lit("clash")})
    made = infill.transform(df)
    assert made.columns == [c for c in df.columns if c not in ("form", "N")] + ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    rows = made.select("*", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    got = sorted(str((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["output_sha256"])) for r in rows)
    want = sorted(str((i, t, *by_hand(i, t), sha(by_hand(i, t)[4]))) for i, t in texts)
    assert got == want and set(CLASHING) <= set(made.columns)
    assert all(r["back"]["text"] == (r["text"] or "") and r["back"]["sha256"] == sha(r["text"]) for r in rows)
    assert infill.transform(empty(spark)).count() == 0


@pytest.mark.parametrize("unit", ["line", "char"])
def test_round_trips_under_any_rules(unit):
    rng = random.Random(unit)
    for n in range(400):
        text = "".join(rng.choice("ab<>PSM\n é日🙂") for _ in range(rng.randrange(40))).encode()
        rules = Rules(unit, arranged=rng.choice([0, 50, 100]), spm=rng.choice([0, 50, 100]), seed=n)
        count, form, before, middle, output, digest = transform_one(text, str(n), rules)
        assert restore_one(output, form) == (text, hashlib.sha256(text).hexdigest())
        assert digest == hashlib.sha256(output).hexdigest()
        assert (form == "plain") == (before is None) and (rules.arranged or form == "plain")
        if unit == "char":
            assert count == len(text.decode())
        if form == "psm":
            assert output.decode()[3:][:before] == text.decode()[:before]
            assert output.decode()[len(output.decode()) - middle :] == text.decode()[before : before + middle]


def test_cuts_split_descriptors_and_leave_buffers_alone():
    table = PieceTable(b"abcdef")
    parts = table.cut(2, 2)
    assert [[d[1:] for d in p if d[1] < d[2]] for p in parts] == [[(0, 2)], [], [(2, 6)]]
    table.arrange([parts[0], parts[2], parts[1]], "spm")
    assert table.text() == b"<S>cdef<P>ab<M>"
    assert b"".join(b"".join(bytes(table.buffers[b][i:j]) for b, i, j in p) for p in table.cut(1, 5, 15)) == table.text()
    assert bytes(table.buffers[0]) == b"abcdef"


def test_a_broken_output_is_an_error():
    for output in (b"<P>a<S>b", b"x<P>a<S>b<M>c", b""):
        with pytest.raises(ValueError, match="form psm"):
            restore_one(output, "psm")

"""Bounded prompts, in order, over several levels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import reduction as R
from threadloom.operators.models import complete_prompts


def estimated(text):
    return max(1, len(text) // 4)


def reply(text):
    """The first and last number of a prompt and how many there are, in a text of some length."""
    numbers = re.findall(r"#\d+", text)
    if not numbers:
        return "pad"
    count = sum(map(int, re.findall(r"=(\d+)", text))) or len(numbers)
    return f"{numbers[0]} {numbers[-1]} ={count}" + " pad" * 20


def asker(fail=""):
    def complete(_, user):
        if fail and fail in user:
            raise ValueError("failed")
        return reply(user)

    def ask(prompts):
        done = complete_prompts(prompts.withColumn("_s", F.lit("")), "_s", "text", [("m", complete)])
        return done.drop("_s", "reply_model", "error")

    return ask


def test_three_levels_keep_order_and_limit(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = random.Random(3)
    rows, want = [], {}
    for g, n in (("a", 60), ("b", 3), (None, 25), ("c", 1)):
        for i in range(n):
            filler = " ".join("w" * rng.randrange(1, 7) for _ in range(rng.randrange(40)))
            rows.append((g, i, f"#{i} {filler}"))
        want[g] = f"#0 #{n - 1} ={n}"
    rows += [("a", 7.5, "  "), ("d", 0, ""), ("e", 0, None)]
    rows = [(g, float(i), t) for g, i, t in rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at double, text string").repartition(5)
    seen = []

    def ask(prompts):
        seen.append(sorted((r.g or "", r.prompt, r.text) for r in prompts.collect()))
        return asker()(prompts)

    got = {r.g: r for r in R.reduce_texts(df, ["g"], ["at"], "text", ask, limit=120).collect()}
    assert {g: (r.summary.split(" pad")[0], r.failed) for g, r in got.items()} == {g: (w, 0) for g, w in want.items()}
    assert got["a"].levels == len(seen) >= 3 and got["c"].levels == 1
    # by hand: each level's prompts, packed in order
    texts = {}
    for g, at, t in sorted((r for r in rows if (r[2] or "").strip()), key=lambda r: r[1]):
        texts.setdefault(g or "", []).append(t)
    for level in seen:
        for g in {g for g, _, _ in level}:
            prompts = [t for h, _, t in level if h == g]
            assert all(estimated(t) <= 120 for t in prompts)
            # in order, nothing lost: the words of the level before, one after the other
            assert " ".join(prompts).split() == " ".join(texts[g]).split()
            if len(prompts) > 2:
                assert min(map(estimated, prompts[:-1])) > 120 // 3
            texts[g] = [reply(t) for t in prompts]


def test_long_texts_and_words_are_cut(spark):
    text = "start " + "x" * 333 + "\n\nend " + "日本語" * 60 + " " + "ab " * 100
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "id int, text string")
    rows = R.cut_texts(df, "text", 20).orderBy("id", "piece").collect()
    assert [r.text for r in rows if r.id == 2] == ["short"] and not [r for r in rows if r.id == 3]
    mine = [r for r in rows if r.id == 1]
    assert [r.piece for r in mine] == list(range(len(mine))) and all(r.tokens <= 20 for r in mine)
    assert "".join("".join(r.text.split()) for r in mine) == "".join(text.split())


def test_failed_calls_are_counted_and_left_out(spark):
    rows = [("a", i, f"#{i} " + "w " * 40) for i in range(30)] + [("b", i, "bad " + "w " * 40) for i in range(30)] + [("c", 0, "bad")]
    df = spark.createDataFrame(rows, "g string, at int, text string").withColumn(
        "text", F.when((F.col("at") == 29) & (F.col("g") == "a"), F.concat("text", F.lit(" bad"))).otherwise(F.col("text"))
    )
    got = {r.g: r for r in R.reduce_texts(df, ["g"], ["at"], "text", asker("bad"), limit=120).collect()}
    assert got["b"].summary is None and got["b"].failed > 1 and got["c"].summary is None and got["c"].failed == 1
    assert got["a"].failed == 1 and got["a"].summary.startswith("#0 ") and 0 < int(re.search(r"=(\d+)", got["a"].summary)[1]) < 30


def test_a_model_that_repeats_its_prompt_is_an_error(spark):
    df = spark.createDataFrame([("a", i, "w " * 60) for i in range(20)], "g string, at int, text string")
    with pytest.raises(RuntimeError, match="do not shrink"):
        R.reduce_texts(df, ["g"], ["at"], "text", lambda p: p.withColumn("reply", F.concat("text", F.lit(" "), "text")), limit=120)
    with pytest.raises(ValueError, match="too small"):
        R.reduce_texts(df, ["g"], ["at"], "text", lambda p: p, limit=10)
    none = R.reduce_texts(df.limit(0), ["g"], ["at"], "text", asker(), limit=120)
    assert none.count() == 0 and none.columns == ["g", "summary", "levels", "failed"]

"""Chunk packing against a plain reading of its rules."""

import random

from threadloom.operators import chunking


def count(text):
    return max(1, len(text) // 4)


def units(text, limit):
    pieces = [s.strip() + "." for s in text.split(".") if s.strip()]
    for number, piece in enumerate(pieces):
        if count(piece) > limit:
            for word in piece.split():
                yield word, count(word + " "), number
        else:
            yield piece, count(piece), None


def expected(text, limit):
    groups, held, part = [], 0, "start"
    for piece, size, number in units(text, limit):
        if not groups or number != part or held + size > limit:
            groups.append([])
            held = 0
        groups[-1].append((piece, size))
        held += size
        part = number
    joined = [(" ".join(p for p, _ in g), sum(n for _, n in g)) for g in groups]
    return [(i, *c) for i, c in enumerate(c for c in joined if len(c[0]) >= 20)]


def run(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in chunking.create_chunks(df, "t", limit).collect():
        got.setdefault(r.i, []).append((r.seq, r.text, r.token_count))
    return [sorted(got.get(i, [])) for i in range(len(texts))]


def test_random_texts(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        words = ["w" * rng.randint(1, 30) for _ in range(rng.randint(0, 120))]
        texts.append(" ".join(w + rng.choice(["", "", "", ".", "..", "\n"]) for w in words))
    for limit in (3, 10, 40):
        assert run(spark, texts, limit) == [expected(t, limit) for t in texts]


def test_long_sentence_shares_no_chunk(spark):
    text = "short one here. " + "word " * 40 + ". and a short tail sentence"
    chunks = run(spark, [text], 20)[0]
    assert chunks == expected(text, 20)
    assert chunks[-1][1] == "and a short tail sentence."


def test_word_over_the_limit_is_a_chunk(spark):
    text = "a " + "x" * 200 + " b"
    assert any(c[1] == "x" * 200 for c in run(spark, [text], 10)[0])


def test_real_tokenizer(spark):
    from threadloom.functions.tokens import tokenizer_counts

    counter = tokenizer_counts(lambda: lambda texts: [t.split() for t in texts])
    df = spark.createDataFrame([("one two three. four five six seven eight. nine",)], "t string")
    chunks = chunking.create_chunks(df, "t", 5, counter).collect()
    assert [(c.text, c.token_count) for c in chunks] == [
        ("four five six seven eight.", 5),
    ]

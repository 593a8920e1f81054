"""Main text, quality and toxicity: made pages, held-out accuracy, and odd rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, prose, with_clashes
from threadloom.llm import html_extract, html_model, quality_model, toxicity
from threadloom.llm.html_blocks import blocks
from threadloom.llm.labelled import fold, sampled_texts
from threadloom.llm.model_queries import op1_main_text, op2_quality, op4_toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_blocks_of_a_broken_page():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> -->"
        '<script>var t="</p>";</script><nav><ul><li><a href="x>y">One</a><li>Two</ul></nav>'
        "<article class='Post main'><h1>A &amp;amp; B</h1><p><b>x\n\n y<br>z<p>&lt;tag&gt; caf&eacute;&nbsp;1</article"
        "><footer>f < 3"
    )
    found = blocks(page)
    assert [b.text for b in found] == ["One", "Two", "A &amp; B", "x y z", "<tag> café 1", "f < 3"]
    assert found[0].link_chars == 3 and found[2].path == ("html", "body", "article", ".post", ".main", "h1")
    assert found[-1].path == ("html", "body", "footer")
    assert blocks(None) == [] and blocks("") == [] and [b.text for b in blocks("plain")] == ["plain"]


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<svg class="i"/><p>one</p><svg></svg><p>two', ["one", "two"]),
        ('<svg-icon name="x"></svg-icon><p>one</p><template-x><p>two</template-x>', ["one", "two"]),
        ("<p>so <math><mi>x</mi></math> is <object data='y'>four</object>.</p>", ["so x is four."]),
        ("<p>a<svg><title>t</title><svg><text>no</text></svg><foreignObject><div>no</div></foreignObject>no</svg> b", ["a b"]),
        ("<svg><path d='M0'><p>one</p><svg><text>no</text></svg><p>two", ["one", "two"]),
        ("<script>no</script ><style>no</style><template><p>no</template>one", ["one"]),
        ("<p>one <noscript>Please enable <b>JavaScript</b></noscript>two<p>three", ["one two", "three"]),
        ("<noscript><p>only</p>this</noscript><script>no</script>", ["only", "this"]),
        ("<p>one<NoScript><p>two", ["one", "two"]),
    ],
)
def test_blocks_keep_text_beside_what_is_skipped(inner, want):
    assert [b.text for b in blocks(f"<body><article>{inner}</article></body>")] == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<head><title>t</title><article><p>text", [("text", ("article", "p"))]),
        ("<html><head><title>t</title><meta a>text<p>more", [("text", ("html",)), ("more", ("html", "p"))]),
        ("<head><span>text</span><title>t</title>", [("text", ())]),
        ("<head><title>t <p>u</title><noscript><link></noscript></head><body><p>x", [("x", ("body", "p"))]),
    ],
)
def test_blocks_of_a_head_left_open(page, want):
    assert [(b.text, b.path) for b in blocks(page)] == want


def test_labels_of_made_pages():
    net = html_model.fit()
    rows = html_model.learning_rows(150, 12345)
    got = html_model.label_pages(net, [x for x, _ in rows])
    right = np.concatenate([g == (y > 0) for g, (_, y) in zip(got, rows)])
    assert right.mean() > 0.98


def test_main_text_of_all_pages(spark):
    """The pages' articles, read by their tags, are what the labeller finds."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r["page_id"]: r for r in op1_main_text(spark, SF_DIR).collect()}
    wrong = 0
    for r in pages.collect():
        article = re.search("<article>.*?</article>", r["html"], re.S).group()
        want = "\n".join(b.text for b in blocks(article))
        wrong += got[r["page_id"]]["text"] != want
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert len(got) == pages.count() and wrong <= 0.01 * len(got)


def test_main_text_without_comments_forms_and_notices(spark):
    html = (
        "<html><body><header><h1>Site name</h1></header><div class='cookie-notice'><p>We use cookies.</p></div>"
        "<main><article><h1>Title here</h1><p>First paragraph of the story, long enough to be read.</p>"
        "<p>Second   one &amp; more.</p></article></main><aside class='sidebar'><p>Popular now.</p></aside>"
        "<section class='comments'><h3>Comments</h3><p>I disagree with this story.</p></section>"
        "<form><label>Mail</label><button>Send</button></form><footer>&copy; site</footer></body></html>"
    )
    rows = [(1, "u", html), (2, "u", None), (3, None, ""), (None, "u", html), (4, "u", "<p>" + "x " * 50_000), (5, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("c"), "m": F.lit("c")})
    got = html_extract.extract(df).collect()
    assert len(got) == 6
    want = "Title here\nFirst paragraph of the story, long enough to be read.\nSecond one & more."
    assert got[0]["text"] == want and got[3]["text"] == want
    assert got[1]["text"] == "" and got[2]["text"] == "" and got[1]["n_chars"] == 0
    assert html_extract.extract(df.where("false")).count() == 0


def accuracy(spark, rows, label):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    joined = rows.where("held_out").join(labels, "doc_id").select(F.col(label).alias("y"), "predicted", "score").collect()
    y, p = np.array([r["y"] for r in joined]), np.array([r["predicted"] for r in joined])
    assert all(0 <= r["score"] <= 1 for r in joined)
    return [(p[y == k] == k).mean() for k in (0, 1)]


def test_quality_of_held_out_documents(spark):
    rows = op2_quality(spark, SF_DIR)
    bad, good = accuracy(spark, rows, "quality")
    assert rows.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert good > 0.95 and bad > 0.85


def test_toxicity_of_held_out_documents(spark):
    clean, toxic = accuracy(spark, op4_toxicity(spark, SF_DIR), "toxic")
    assert clean > 0.98 and toxic > 0.8


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    positive = rng.normal(1.5, 1, (4000, 3))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (4200, 3)), rng.normal(-1.5, 1, (1800, 3))])
    net = quality_model.fit_network(positive, unlabelled)
    assert abs(net.prior - 0.7) < 0.1
    p = net.probability(np.concatenate([positive[:500], rng.normal(-1.5, 1, (500, 3))]))
    assert (p[:500] > 0.5).mean() > 0.95 and (p[500:] < 0.5).mean() > 0.95


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 100_000), (5, prose(1, 20_000)), (5, prose(1, 20_000)), (None, "a b c")]


@pytest.mark.parametrize("scorer", ["quality", "toxicity"])
def test_scores_of_odd_rows(spark, scorer):
    df = with_clashes(documents(spark, ODD))
    if scorer == "quality":
        net = quality_model.fit(df, df.where("doc_id > 1"))
        make = lambda d, m: quality_model.score(F.col("text"), m)
    else:
        labels = spark.createDataFrame([(4, 1), (5, 0), (2, None), (None, 1)], "doc_id long, toxic int")
        net = toxicity.fit(df, labels)
        make = lambda d, m: toxicity.score(F.col("text"), m)["score"]
    for model in (net, None):
        got = df.select("doc_id", make(df, model).alias("s")).collect()
        assert len(got) == len(ODD) and all(0 <= r["s"] <= 1 for r in got)
        assert got[4]["s"] == got[5]["s"]
        assert empty(spark).select(make(df, model)).count() == 0
    assert quality_model.fit(empty(spark), empty(spark)) is None
    assert toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_offending_sentences_are_located(spark):
    texts = [(n, prose(n, 60) + (". You absolute numpty there. " if n % 2 else ". Fine words here. ") + prose(n + 1000, 40)) for n in range(300)]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(n, n % 2) for n, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = df.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("s")).collect()
    for r in got:
        places = [r["text"][p["start"] : p["stop"]] for p in r["s"]["sentences"]]
        assert bool(places) == bool(r["doc_id"] % 2) == (r["s"]["score"] >= 0.7)
        assert all("numpty" in p for p in places)


def test_noisy_or():
    assert toxicity.noisy_or(np.array([])) == 0
    z = np.array([-1.0, 0.5, -3.0])
    p = 1 / (1 + np.exp(-z))
    assert abs(toxicity.noisy_or(z) - (1 - np.prod(1 - p))) < 1e-12


def test_fold_of_a_key(spark):
    import zlib

    rows = spark.createDataFrame([(n,) for n in range(50)] + [(None,)], "k long")
    for r in rows.select("k", fold(F.col("k"), 4).alias("f")).collect():
        assert r["f"] == zlib.crc32(b"" if r["k"] is None else str(r["k"]).encode()) % 4


def test_keys_of_many_documents_teach_by_one_text(spark):
    """A sampled key brings one row, the same however the rows lie."""
    rows = [(7, f"text {i}") for i in range(500)] + [(7, None), (8, "b"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "key long, y int")
    least = min((t for i, t in rows if i == 7 and t), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for parts in (1, 6):
        got = sampled_texts(docs.repartition(parts), "doc_id", "text", keys)
        assert got.columns == ["key", "y", "text"]
        found = {tuple(r) for r in got.collect()}
        # a null digest comes first
        assert found == {(7, 1, None), (8, 0, "b")}
        without = sampled_texts(docs.where("text IS NOT NULL").repartition(parts), "doc_id", "text", keys)
        assert {tuple(r) for r in without.collect()} == {(7, 1, least), (8, 0, "b")}

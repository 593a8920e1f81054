"""Text steps on hand-made input."""

import html as stdlib_html
import unicodedata

import pytest
from pyspark.sql import functions as F

from threadloom.functions import html, lexicons, strings, text
from threadloom.functions.unicode import fold_ascii
from threadloom.operators import cleaning
from threadloom.functions.text import CleanOptions


def apply(spark, step, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = rows.select("i", step(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(out)]


def test_links(spark):
    assert apply(
        spark,
        text.links_to_hosts,
        "a http://www.b.com:80/x?q and www.gone.net/y z",
        "two https://u@h.org#f http://x.y/?a",
        "inner http://a.www.b.com/c",
        "none",
        "httpx no host",
    ) == [
        "a b.com:80 and  z",
        "two u@h.org x.y",
        "inner a.b.com",
        "none",
        " no host",
    ]


def test_broken_link_keeps_the_text(spark):
    raw = "Über http://[bad/x  text"
    df = spark.createDataFrame([(raw,), ("é http://[::1]/x",)], "t string")
    got = [r.c for r in cleaning.normalize(df, "t", "c").collect()]
    assert got[0] == raw
    assert got[1] == "e [::1]"
    cleaned = [r.c for r in cleaning.clean_corpus(df, "t", "c").collect()]
    assert cleaned[0] == "Über http://[bad/x text"


def test_fold_ascii(spark):
    texts = ["plain", "éàü ß ﬁ ½ … Ａ", "日本", ""]
    want = [
        unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii") for t in texts
    ]
    assert apply(spark, fold_ascii, *texts) == want


@pytest.mark.parametrize(
    "source",
    [
        "a &amp;lt; b", "&eacute;&#233;&#xE9;&#Xe9;", "&foo; AT&T &copy 3", "x&nbsp;y",
        "&NotEqualTilde; &#128512;", "&&amp;&", "no entity", "&",
    ],
)
def test_entities(spark, source):
    assert apply(spark, html.decode_entities, source) == [stdlib_html.unescape(source)]


def test_visible_text(spark):
    assert apply(
        spark,
        html.visible_text,
        "<p>Hi <b>there</b>  you</p><!-- no > --><script>x<y</script> 3 < 5 &amp; 6 > 4",
        "  bare  ",
        "<br>",
        None,
    ) == ["Hi there you 3 < 5 & 6 > 4", "bare", "", None]


def test_visible_text_leaves_open_references(spark):
    source = "<p>a&&amp b &lt;i&gt &amp;lt; &#39;c&#39 &copy 3 &amp"
    assert apply(spark, html.visible_text, source) == ["a&&amp b <i&gt &lt; 'c&#39 &copy 3 &amp"]
    assert apply(spark, lambda c: html.visible_text(c, bare=True), source) == ["a&& b <i> &lt; 'c&#39 © 3 &"]


def test_contractions(spark):
    assert apply(spark, text.expand_contractions, "I'm  sure they don't, don't DON'T") == [
        "I am sure they don't, do not DON'T"
    ]
    assert len(lexicons.CONTRACTIONS) == 120


def test_pad_leaves_backslash(spark):
    assert apply(spark, text.pad_punctuation, r"a,b\c[d]") == [r"a , b\c [ d ]"]


def test_unicode_space(spark):
    spaced = "  a \x1cb 　"
    assert apply(spark, strings.squeeze, spaced) == [" ".join(spaced.split())]
    assert apply(spark, lambda c: F.array_join(strings.words(c), "|"), spaced) == ["a|b"]


def test_clean_corpus_drops_null_and_blank(spark):
    df = spark.createDataFrame([("a  b",), (" \n ",), (None,), ("日本",)], "t string")
    assert [r.c for r in cleaning.clean_corpus(df, "t", "c").collect()] == ["a b"]


def test_clean_corpus_evaluates_once(spark):
    df = spark.createDataFrame([("a",)], "t string")
    options = CleanOptions(contractions=True, alphanumeric_only=True, padding=True)
    plan = cleaning.clean_corpus(df, "t", "c", options)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("<script") == 1


def test_valid_chunk(spark):
    assert apply(
        spark,
        text.is_valid_chunk,
        "<content>five words with enough letters</content>",
        "a b c d e f g h i j k l m n o p",
        "<content>four words with space</content> and more words after it here",
        None,
    ) == [True, False, False, False]


def test_mask(spark):
    assert apply(spark, lambda c: text.mask_words(c, ["Damn"]), "well damn, damned DAMN") == [
        "well ***** damned ****"
    ]

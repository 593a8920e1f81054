"""Text cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    NW, POSTS, SQL_TIME_TEXT, W, W_RANGES, ntz, posts, read, sql_squeeze, sql_strip, sql_words,
)
from catalog.files import CONTRACTED, _lexicon_sql
from threadloom.functions import html, lexicons, strings, text, tokens
from threadloom.functions.text import CleanOptions
from threadloom.functions.unicode import fold_ascii
from threadloom.operators import chunking, cleaning

LEXICON = ["the", "der", "que", "con"]

# the same text expression in both engines, per step
LINKED = "concat('see ', url, ' and http://www.site.org:80/a?b#c or www.gone.net/x, https://x.y', chr(10), 'end')"
WIKI = "concat('a thumb|200px|right|', text, ' left|12px| 300px| x center|')"
BROKEN = "concat('head', chr(10), chr(10), 'junk', chr(10), chr(10), chr(10), text)"
QUOTED = "concat('  >>>', CAST(doc_id AS STRING), ' >> ', text, ' >>123 and >>', CAST(doc_id AS STRING))"
SPACED = "concat('  ', replace(text, ' ', concat(chr(9), ' ')), chr(10))"
FLAGS = "CASE doc_id % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'on' WHEN 2 THEN 'Y' WHEN 3 THEN '0' WHEN 4 THEN 'no' ELSE lang END"
CHUNKY = "concat('  ', replace(text, '. ', concat(' ', chr(10), chr(9), chr(10), ' ')))"


def _documents(step, expr: str = "text"):
    def query(spark, sf):
        d = read(spark, sf, "documents").withColumn("x", F.expr(expr))
        return d.select("doc_id", step(F.col("x")).alias("cleaned"))

    return query


def txt_links(spark, sf):
    p = read(spark, sf, "pages").withColumn("x", F.expr(LINKED))
    return p.select("page_id", text.links_to_hosts(F.col("x")).alias("cleaned"))


def txt_markup(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", html.visible_text(F.col("html")).alias("cleaned"))


def txt_normalize(spark, sf):
    d = cleaning.normalize(read(spark, sf, "documents"), "text", "cleaned")
    return d.select("doc_id", "cleaned")


def txt_clean_corpus(spark, sf):
    options = CleanOptions(contractions=True, alphanumeric_only=True, padding=True)
    d = read(spark, sf, "documents").withColumn("text", F.expr(CONTRACTED))
    return cleaning.clean_corpus(d, "text", "cleaned", options).select("doc_id", "cleaned")


def txt_mask_words(spark, sf):
    """A lexicon in the plan, and the same as a table."""
    d = read(spark, sf, "documents")
    table = spark.createDataFrame([(w,) for w in LEXICON], "token string")
    joined = cleaning.mask_words(d.select("doc_id", "text"), "text", "doc_id", table)
    listed = d.select("doc_id", text.mask_words(F.col("text"), LEXICON).alias("listed"))
    return joined.withColumnRenamed("text", "joined").join(listed, "doc_id")


def txt_string_to_bool(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", lexicons.string_to_bool(F.expr(FLAGS)).alias("flag"))


def chk_sentences(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("seq", "sentence"))


def chk_token_counts(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", tokens.estimate(F.col("text")).alias("tokens"))


def chk_pack(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    return chunking.create_chunks(d, "text", 1000)


def chk_pack_words(spark, sf):
    """A small limit, so that most sentences are cut into words."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    return chunking.create_chunks(d, "text", 60)


def chk_posts(spark, sf):
    p = posts(spark, sf).select("doc_id", "thread_id", "posted_date_time", "text")
    return chunking.chunk_posts(p, limit=300).withColumn(
        "posted_date_time", ntz("posted_date_time")
    )


QUERIES = {
    "txt_links": txt_links,
    "txt_fold_ascii": _documents(fold_ascii),
    "txt_wiki_images": _documents(text.drop_wiki_images, WIKI),
    "txt_double_breaks": _documents(text.fold_double_breaks, BROKEN),
    "txt_newlines": _documents(text.fold_newlines),
    "txt_markup": txt_markup,
    "txt_post_references": _documents(text.drop_post_references, QUOTED),
    "txt_leading_quotes": _documents(text.drop_leading_quotes, QUOTED),
    "txt_contractions": _documents(text.expand_contractions, CONTRACTED),
    "txt_non_alphanumeric": _documents(text.drop_non_alphanumeric),
    "txt_squeeze": _documents(strings.squeeze, SPACED),
    "txt_remove_whitespace": _documents(text.remove_whitespace, CHUNKY),
    "txt_pad_punctuation": _documents(text.pad_punctuation),
    "txt_normalize": txt_normalize,
    "txt_clean_corpus": txt_clean_corpus,
    "txt_mask_words": txt_mask_words,
    "txt_string_to_bool": txt_string_to_bool,
    "txt_clean_chunk": _documents(text.clean_chunk_text, CHUNKY),
    "chk_sentences": chk_sentences,
    "chk_token_counts": chk_token_counts,
    "chk_pack": chk_pack,
    "chk_pack_words": chk_pack_words,
    "chk_posts": chk_posts,
}


def _sql(step: str, expr: str = "text") -> str:
    return f"WITH d AS (SELECT doc_id, {expr} AS x FROM documents) SELECT doc_id, {step} AS cleaned FROM d"


def _re(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _links(x: str) -> str:
    pattern = rf"http[a-zA-Z0-9+.\-]*://(?:www\.)?([^/?#{W_RANGES}]*){NW}*|http{NW}+|www[^\n]{NW}+"
    return _re(x, pattern, r"\1")


def _fold(x: str) -> str:
    return _re(f"strip_accents({x})", r"[^\x{0}-\x{7F}]")


def _wiki(x: str) -> str:
    return _re(x, r"(?:thumb|right|left|center)\|[\dpx]*\|?|[\dpx]+\|")


def _breaks(x: str) -> str:
    return _re(x, r"\n\n[^\n]*?\n\n*?\n", " ")


def _newlines(x: str) -> str:
    return f"replace({x}, chr(10), ' ')"


def _markup(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(1), 'g')"
    x = rf"regexp_replace({x}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', chr(1), 'g')"
    x = f"regexp_replace({x}, '<[a-zA-Z/!?][^>]*>', chr(1), 'g')"
    for name, char in (
        ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"),
        ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"),
        ("&amp;", "'&'"),
    ):
        x = f"replace({x}, '{name}', {char})"
    piece = sql_strip("s")
    return (
        f"array_to_string(list_filter(list_transform(string_split({x}, chr(1)), "
        f"lambda s: {piece}), lambda s: s <> ''), ' ')"
    )


def _references(x: str) -> str:
    return _re(x, r">>\d+", " ")


def _quotes(x: str) -> str:
    return _re(x, r"(?m)^\s*>+")


def _alnum(x: str) -> str:
    return _re(x, r"[^a-zA-Z0-9.,!?'' ]", " ")


def _pad(x: str) -> str:
    mark = r"([\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}\x{5D}-\x{60}\x{7B}-\x{7E}])"
    return sql_squeeze(_re(x, mark, r" \1 "))


def _chain(source: str, steps, key: str = "doc_id") -> str:
    """One common table expression per step."""
    parts = [f"s0 AS (SELECT {key}, {source} AS x FROM documents)"]
    for i, step in enumerate(steps, 1):
        parts.append(f"s{i} AS (SELECT {key}, {step('x')} AS x FROM s{i - 1})")
    return f"WITH {', '.join(parts)} SELECT {key}, x AS cleaned FROM s{len(steps)}"


_NORMAL = [_links, _fold, _wiki, _breaks, _newlines, _markup, _references, _wiki, _quotes]


def _contract(x: str) -> str:
    lookup = _lexicon_sql().split("lexicon AS (SELECT ")[1].split(" AS m)")[0]
    return f"array_to_string(list_transform({sql_words(x)}, lambda w: coalesce(({lookup})[w], w)), ' ')"


def _mask(x: str) -> str:
    lexicon = ", ".join(f"'{w}'" for w in LEXICON)
    hit = f"list_has_any(regexp_split_to_array(lower(w), '[^0-9A-Za-z_]+'), [{lexicon}])"
    return (
        f"array_to_string(list_transform({sql_words(x)}, lambda w: "
        f"CASE WHEN {hit} THEN repeat('*', length(w)) ELSE w END), ' ')"
    )


def clean_chunk_sql(x: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), "
        f"lambda s: {sql_strip('s')}), lambda s: s <> ''), chr(10))"
    )


def _sentences(x: str) -> str:
    stripped = f"list_transform(string_split({x}, '.'), lambda s: {sql_strip('s')})"
    return f"list_transform(list_filter({stripped}, lambda s: s <> ''), lambda s: s || '.')"


def packed_sql(source: str, keys: str, limit: int) -> str:
    """Greedy packing as a recursion over the units of each text.

    ``source`` is a query of (keys, doc_id, x).
    """
    return f"""
    texts AS ({source}),
    sent AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i
             FROM (SELECT doc_id, {_sentences('x')} AS l FROM texts)),
    cut AS (SELECT doc_id, i, -1 AS part, [s] AS u, [greatest(1, length(s) // 4)] AS c FROM sent
              WHERE greatest(1, length(s) // 4) <= {limit}
            UNION ALL
            SELECT doc_id, i, i AS part, w AS u,
                   list_transform(w, lambda y: greatest(1, (length(y) + 1) // 4)) AS c
            FROM (SELECT doc_id, i, {sql_words('s')} AS w FROM sent
                  WHERE greatest(1, length(s) // 4) > {limit})),
    units AS (SELECT doc_id, part, u, c, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos
              FROM (SELECT doc_id, i, part, unnest(u) AS u, unnest(c) AS c,
                           generate_subscripts(u, 1) AS j FROM cut)),
    walk AS (SELECT doc_id, pos, part, c AS held, 1 AS chunk FROM units WHERE pos = 1
             UNION ALL
             SELECT n.doc_id, n.pos, n.part,
                    CASE WHEN w.held + n.c > {limit} OR w.part <> n.part THEN n.c ELSE w.held + n.c END,
                    CASE WHEN w.held + n.c > {limit} OR w.part <> n.part THEN w.chunk + 1 ELSE w.chunk END
             FROM walk w JOIN units n ON n.doc_id = w.doc_id AND n.pos = w.pos + 1),
    chunks AS (SELECT doc_id, chunk, string_agg(u, ' ' ORDER BY pos) AS text,
                      CAST(sum(c) AS INT) AS token_count
               FROM walk JOIN units USING (doc_id, pos) GROUP BY doc_id, chunk),
    packed AS (SELECT {keys} doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS INT) AS seq,
                      chunks.text, token_count
               FROM chunks JOIN texts USING (doc_id) WHERE length(chunks.text) >= 20)"""


framed_sql = (
    f"concat_ws(chr(10), '<temporal_context>', 'Posted: ' || {SQL_TIME_TEXT}, "
    "'Thread: ' || thread_id, '</temporal_context>', "
    "'<content>', text, '</content>')"
)
_CONTENT = sql_strip(
    "split_part(list_extract(string_split(text, '<content>'), -1), '</content>', 1)"
)
VALID_SQL = (
    f"len(list_filter(regexp_split_to_array({_CONTENT}, '{W}+'), lambda w: length(w) > 2)) >= 5 "
    f"AND length({_CONTENT}) >= 20"
)
_PLAIN = "SELECT doc_id, text AS x FROM documents"
_POST_TEXTS = (
    f"SELECT doc_id, thread_id, posted_date_time, {clean_chunk_sql(framed_sql)} AS x FROM posts "
    f"WHERE length({sql_strip('text')}) >= 20"
)

ORACLES = {
    "txt_links": f"WITH d AS (SELECT page_id, {LINKED} AS x FROM pages) SELECT page_id, {_links('x')} AS cleaned FROM d",
    "txt_fold_ascii": _sql(_fold("x")),
    "txt_wiki_images": _sql(_wiki("x"), WIKI),
    "txt_double_breaks": _sql(_breaks("x"), BROKEN),
    "txt_newlines": _sql(_newlines("x")),
    "txt_markup": f"SELECT page_id, {_markup('html')} AS cleaned FROM pages",
    "txt_post_references": _sql(_references("x"), QUOTED),
    "txt_leading_quotes": _sql(_quotes("x"), QUOTED),
    "txt_contractions": _sql(_contract("x"), CONTRACTED),
    "txt_non_alphanumeric": _sql(_alnum("x")),
    "txt_squeeze": _sql(sql_squeeze("x"), SPACED),
    "txt_remove_whitespace": _sql(sql_squeeze("x"), CHUNKY),
    "txt_pad_punctuation": _sql(_pad("x")),
    "txt_normalize": _chain("text", [*_NORMAL, sql_squeeze]),
    "txt_clean_corpus": _chain(
        CONTRACTED, [*_NORMAL, _contract, _alnum, sql_squeeze, _pad]
    ) + " WHERE x <> ''",
    "txt_mask_words": f"SELECT doc_id, {_mask('text')} AS joined, {_mask('text')} AS listed FROM documents",
    "txt_string_to_bool": f"""SELECT doc_id, lower({FLAGS}) IN ('true', '1', 't', 'y', 'yes', 'on') AS flag
        FROM documents""",
    "txt_clean_chunk": _sql(clean_chunk_sql("x"), CHUNKY),
    "chk_sentences": f"""SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS seq, unnest(l) AS sentence
        FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents)""",
    "chk_token_counts": "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents",
    "chk_pack": f"WITH RECURSIVE {packed_sql(_PLAIN, '', 1000)} SELECT * FROM packed",
    "chk_pack_words": f"WITH RECURSIVE {packed_sql(_PLAIN, '', 60)} SELECT * FROM packed",
    "chk_posts": f"""WITH RECURSIVE {POSTS}, {packed_sql(_POST_TEXTS, 'thread_id, posted_date_time,', 300)}
        SELECT * FROM packed
        WHERE {VALID_SQL}""",
}

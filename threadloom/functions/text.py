"""Cleaning steps for post text, each a Column function."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import lexicons
from threadloom.functions.html import visible_text
from threadloom.functions.strings import (
    NON_SPACE,
    SPACE_CLASS,
    UNICODE,
    let,
    squeeze,
    strip,
    words,
)

# What counts as a link, as wiki image markup, as a quoted post,
# as a removable character, and as punctuation.
LINK = rf"{UNICODE}http[a-zA-Z0-9+.\-]*://([^/?#{SPACE_CLASS}]*){NON_SPACE}*|http{NON_SPACE}+|www[^\n]{NON_SPACE}+"
WIKI_IMAGE = r"(?:thumb|right|left|center)\|[\dpx]*\|?|[\dpx]+\|"
WIKI_IMAGE_REST = r"thumb\|(?:\d*x\d*px\|(?:right\|)?)?|\d*x\d*px\|"
DOUBLE_BREAK = r"\n\n[^\n]*?\n\n*?\n"
POST_REFERENCE = r">>\d+"
LEADING_QUOTE = r"(?dm)^\s*>+"
NON_ALPHANUMERIC = r"[^a-zA-Z0-9.,!?' ]"
PUNCTUATION = r"([\x21-\x2F\x3A-\x40\x5B\x5D-\x60\x7B-\x7E])"

_HOST = rf"http[a-zA-Z0-9+.\-]*://[^/?#\[\]{SPACE_CLASS}]*"
BROKEN_LINK = (
    rf"{UNICODE}{_HOST}(?:\[[^/?#\]{SPACE_CLASS}]*|\][^/?#\[{SPACE_CLASS}]*)(?:[/?#{SPACE_CLASS}]|\z)"
)


def links_to_hosts(c: Column) -> Column:
    """A link becomes its host without ``www.``; a link without scheme goes."""
    # marks around the kept host let "www." be cut there and nowhere else
    marked = F.regexp_replace(c, LINK, "\x01$1\x02")
    cut = F.regexp_replace(marked, "www\\.(?=[^\x01\x02]*\x02)", "")
    hosts = F.translate(cut, "\x01\x02", "")
    return F.when(c.contains("http") | c.contains("www"), hosts).otherwise(c)


def has_broken_link(c: Column) -> Column:
    """A link whose host has an unmatched square bracket."""
    return c.contains("http") & (c.contains("[") | c.contains("]")) & c.rlike(BROKEN_LINK)


def drop_wiki_images(c: Column) -> Column:
    return F.when(c.contains("|"), F.regexp_replace(c, WIKI_IMAGE, "")).otherwise(c)


def drop_wiki_rest(c: Column) -> Column:
    return F.when(c.contains("|"), F.regexp_replace(c, WIKI_IMAGE_REST, "")).otherwise(c)


def fold_double_breaks(c: Column) -> Column:
    return F.when(c.contains("\n\n"), F.regexp_replace(c, DOUBLE_BREAK, " ")).otherwise(c)


def fold_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def drop_post_references(c: Column) -> Column:
    return F.when(c.contains(">>"), F.regexp_replace(c, POST_REFERENCE, " ")).otherwise(c)


def drop_leading_quotes(c: Column) -> Column:
    return F.when(c.contains(">"), F.regexp_replace(c, LEADING_QUOTE, "")).otherwise(c)


def expand_contractions(c: Column, lexicon: dict[str, str] | None = None) -> Column:
    """Whole words found in the lexicon, as cased there, are replaced.

    Words are joined by single spaces.
    """
    lexicon = lexicons.CONTRACTIONS if lexicon is None else lexicon
    if not lexicon:
        return F.array_join(words(c), " ")
    table = lexicons.as_map(lexicon)
    found = lambda w: F.coalesce(F.try_element_at(table, w), w)
    # map lookups scan their keys; all built-in keys have an apostrophe
    if all("'" in k for k in lexicon):
        swap = lambda w: F.when(w.contains("'"), found(w)).otherwise(w)
    else:
        swap = found
    return F.array_join(F.transform(words(c), swap), " ")


def drop_non_alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, NON_ALPHANUMERIC, " ")


def remove_whitespace(c: Column) -> Column:
    return squeeze(c)


def pad_punctuation(c: Column) -> Column:
    """Spaces around every punctuation mark except the backslash."""
    return squeeze(F.regexp_replace(c, PUNCTUATION, " $1 "))


@dataclass(frozen=True)
class CleanOptions:
    """Optional steps of the cleaning job, all off by default."""

    contractions: bool = False
    alphanumeric_only: bool = False
    padding: bool = False
    lexicon: dict[str, str] | None = field(default=None, hash=False)


def ascii_steps(options: CleanOptions = CleanOptions()) -> list:
    """The normalising steps that follow the ASCII fold, in their order."""
    steps = [
        drop_wiki_images,
        fold_double_breaks,
        fold_newlines,
        visible_text,
        drop_post_references,
        drop_wiki_rest,
        drop_leading_quotes,
    ]
    if options.contractions:
        steps.append(lambda c: expand_contractions(c, options.lexicon))
    if options.alphanumeric_only:
        # the squeeze that follows makes one space of a run anyway
        steps.append(lambda c: F.regexp_replace(c, NON_ALPHANUMERIC + "+", " "))
    steps.append(squeeze)
    return steps


def mask_words(c: Column, lexicon: list[str]) -> Column:
    """A word holding a flagged word becomes as many stars as it has letters.

    For a lexicon that fits in the plan; ``operators.cleaning.mask_words``
    takes one of any size.
    """
    flagged = F.array(*[F.lit(w.lower()) for w in lexicon])
    return F.array_join(F.transform(words(c), lambda w: mask_word(w, flagged)), " ")


def mask_word(w: Column, flagged: Column) -> Column:
    pieces = F.split(F.lower(w), r"\W+")
    return F.when(F.arrays_overlap(pieces, flagged), F.repeat(F.lit("*"), F.length(w))).otherwise(w)


def clean_chunk_text(c: Column) -> Column:
    """Lines stripped, blank lines dropped."""
    lines = F.transform(F.split(c, "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def is_valid_chunk(c: Column, min_words: int = 5, min_chars: int = 20) -> Column:
    """Enough words of three letters or more, and enough characters.

    Counts the text after the last ``<content>`` and before the first
    ``</content>`` that follows.
    """
    opened = F.substring_index(c, "<content>", -1)

    def enough(content: Column) -> Column:
        long_words = F.regexp_count(content, F.lit(f"{UNICODE}{NON_SPACE}{{3,}}"))
        return (long_words >= min_words) & (F.length(content) >= min_chars)

    found = let(strip(F.substring_index(opened, "</content>", 1)), enough)
    return F.coalesce(found, F.lit(False))


def temporal_wrap(text: Column, posted: Column, thread: Column) -> Column:
    """Put a post into its time and thread frame, as one line per part."""
    return F.concat_ws(
        "\n",
        F.lit("<temporal_context>"),
        F.concat(F.lit("Posted: "), posted),
        F.concat(F.lit("Thread: "), thread),
        F.lit("</temporal_context>"),
        F.lit("<content>"),
        text,
        F.lit("</content>"),
    )

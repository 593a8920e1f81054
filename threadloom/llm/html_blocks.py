"""Web pages as sequences of text blocks, each with the path of tags it lies in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: elements that begin and end a block of text
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main "
    "menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead "
    "title tr ul video audio".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: an opening tag ends open elements of these names, up to a container that holds them
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"},
}
#: any block ends an open paragraph
ENDS_PARAGRAPH = BLOCK_TAGS - {"button", "iframe", "option", "select", "textarea", "video", "audio"}

#: HTML tags that end a drawing left open; its own labels may be HTML inside these elements
ENDS_DRAWING = ENDS_PARAGRAPH - {"title"} | set(
    "b big br code em embed i img meta nobr ruby s small span strike strong sub sup tt u var".split()
)
LABELS = frozenset(("foreignobject", "desc", "title"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|template)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_NO_SCRIPT_END = re.compile(r"</noscript\s*>", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """One leaf: its text, the tags and names around it, and how much of it is link text."""

    text: str
    path: tuple[str, ...]
    link_chars: int


def _names(attributes: str) -> tuple[str, ...]:
    """Words in the class, id and role of a tag."""
    found = []
    for m in _NAMES.finditer(attributes):
        found += _PART.findall((m.group(1) or m.group(2) or m.group(3) or "").lower())
    return tuple("." + n for n in found)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order.

    A block is the text between two boundaries of block elements; a line break
    inside counts as white space, and white space is one space. Comments,
    scripts, styles, templates, drawings and the head's title are not text.
    Unclosed and misnested tags are closed as browsers close them: by a parent's
    end or a next sibling, a drawing also by an HTML tag that cannot stand in it.
    What stands in for scripts is text only on a page without any other.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links: list[str] = []
    in_link = 0
    drawing = labels = 0

    def end_head() -> None:
        """What cannot stand in a head ends it; both of its tags may be left out."""
        if not any(name == "title" for name, _ in stack):
            stack[:] = [s for s in stack if s[0] != "head"]

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                end_head()
            if text and not any(name in ("head", "title") for name, _ in stack):
                path = tuple(t for name, names in stack for t in (name, *names))
                chars = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                out.append(Block(text, path, chars))
            parts.clear()
            links.clear()

    at = skipped = 0
    stand_ins: list[str] = []
    for m in _TOKEN.finditer(page):
        if m.start() < skipped:
            at = max(at, m.end())
            continue
        if m.start() > at and not drawing:
            parts.append(page[at : m.start()])
            if in_link:
                links.append(page[at : m.start()])
        at = m.end()
        name = m.group(3) or m.group(6)
        if name is None:
            continue
        name = name.lower()
        closing = m.group(2) or m.group(5)
        if name == "noscript" and not closing and (end := _NO_SCRIPT_END.search(page, at)):
            stand_ins.append(page[at : end.start()])
            at = skipped = end.end()
            continue
        if drawing or name == "svg":
            # as in browsers, a drawing or a part of it may close itself
            empty = (m.group(4) or m.group(7) or "").endswith("/")
            if name == "svg":
                drawing = max(drawing - 1, 0) if closing else drawing + (not empty)
                labels = labels if drawing else 0
                continue
            if name in LABELS:
                labels = max(labels - 1, 0) if closing else labels + (not empty)
            if labels or closing or name not in ENDS_DRAWING:
                continue
            drawing = 0
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            if closing:
                if any(n == name for n, _ in stack):
                    while stack.pop()[0] != name:
                        pass
            elif name not in VOID_TAGS:
                closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_PARAGRAPH else set())
                while stack and stack[-1][0] in closes:
                    stack.pop()
                if name not in ("html", "head", "title"):
                    end_head()
                attributes = m.group(4) or m.group(7) or ""
                stack.append((name, _names(attributes) if attributes else ()))
                if name == "body":
                    stack[:] = [s for s in stack if s[0] not in ("head", "title")]
    if at < len(page) and not drawing:
        parts.append(page[at:])
    flush()
    return out if out or not stand_ins else blocks("\n".join(stand_ins))

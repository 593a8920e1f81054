"""A bidirectional LSTM in numpy that labels the blocks of a page, and the pages it learns from."""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np

from threadloom.llm.html_blocks import Block, blocks

PATH_SIZE = 320
WORD_SIZE = 32
NUMBERS = 7
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
HIDDEN = 16
#: pages made up to learn from, and passes over them
TRAIN_PAGES = 1400
PASSES = 6
#: share of pages that are learned from without their words
WORDLESS = 0.35
SEED = 3
#: blocks in one padded batch
BATCH_BLOCKS = 16_000


class Vectors:
    """Block vectors: hashed tag path, hashed words, and a few numbers."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        vector = self.paths.get(path)
        if vector is None:
            vector = np.zeros(PATH_SIZE, dtype=np.float32)
            for depth, token in enumerate(reversed(path)):
                vector[zlib.crc32(token.encode()) % PATH_SIZE] += 1.0 if depth < 4 else 0.6
            if len(self.paths) < 50_000:
                self.paths[path] = vector
        return vector

    def word(self, word: str) -> int:
        place = zlib.crc32(word.lower().encode()) % WORD_SIZE
        if len(self.words) < 200_000:
            self.words[word] = place
        return place

    def page(self, found: list[Block]) -> np.ndarray:
        x = np.zeros((len(found), INPUT), dtype=np.float32)
        known = self.words
        for i, b in enumerate(found):
            x[i, :PATH_SIZE] = self.path(b.path)
            words = b.text.split(" ")
            places = [known[w] if w in known else self.word(w) for w in words]
            counts = np.bincount(places, minlength=WORD_SIZE)
            x[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.sqrt((counts * counts).sum())
            n, text = len(b.text), b.text
            x[i, PATH_SIZE + WORD_SIZE :] = (
                np.log1p(n) / 6,
                np.log1p(len(words)) / 5,
                b.link_chars / n,
                sum(map(text.count, ".!?;,")) / n * 10,
                text[-1] in ".!?:…",
                i / len(found),
                "©" in text,
            )
        return x


@dataclass
class Network:
    """Weights of both directions (input, hidden, bias) and of the output."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, *self.b, self.out, self.bias]

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits for padded pages ``x`` (time, page, input); ``keep`` gathers what learning needs."""
        sides = []
        for d in range(2):
            order = range(len(x)) if d == 0 else range(len(x) - 1, -1, -1)
            gates_in = x @ self.wx[d] + self.b[d]
            h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            c = np.zeros_like(h)
            hs = np.zeros((len(x), x.shape[1], HIDDEN), dtype=np.float32)
            trace = []
            for t in order:
                z = gates_in[t] + h @ self.wh[d]
                s = _sigmoid(z[:, : 3 * HIDDEN])
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                on = mask[t][:, None]
                c_new = f * c + i * g
                tc = np.tanh(c_new)
                h_new = o * tc
                if keep is not None:
                    trace.append((t, h, c, i, f, o, g, tc, on))
                # padding passes the state on unchanged
                h, c = on * h_new + (1 - on) * h, on * c_new + (1 - on) * c
                hs[t] = h
            sides.append(hs)
            if keep is not None:
                keep.append(trace)
        both = np.concatenate(sides, axis=2)
        if keep is not None:
            keep.append(both)
        return both @ self.out + self.bias[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    keep: list = []
    p = _sigmoid(net.run(x, mask, keep))
    grad = (p - y) * mask / max(mask.sum(), 1)
    both = keep[2]
    g_out = np.tensordot(both, grad, axes=([0, 1], [0, 1]))
    g_bias = np.array([grad.sum()], dtype=np.float32)
    d_both = grad[:, :, None] * net.out
    gx, gh, gb = [], [], []
    for d in range(2):
        dhs = d_both[:, :, d * HIDDEN : (d + 1) * HIDDEN]
        wh = np.zeros_like(net.wh[d])
        dz_all = np.zeros((len(x), x.shape[1], 4 * HIDDEN), dtype=np.float32)
        dh = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, g, tc, on in reversed(keep[d]):
            dh = dh + dhs[t]
            dh_new, dh = dh * on, dh * (1 - on)
            dc_new = dc * on + dh_new * o * (1 - tc * tc)
            dz = np.concatenate(
                [dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * tc * o * (1 - o), dc_new * i * (1 - g * g)],
                axis=1,
            )
            dc = dc_new * f + dc * (1 - on)
            wh += h.T @ dz
            dh = dh + dz @ net.wh[d].T
            dz_all[t] = dz
        gx.append(np.tensordot(x, dz_all, axes=([0, 1], [0, 1])))
        gh.append(wh)
        gb.append(dz_all.sum(axis=(0, 1)))
    return [*gx, *gh, *gb, g_out, g_bias]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages as (time, page, input) and a mask of the places that are blocks."""
    longest = max(len(p) for p in pages)
    x = np.zeros((longest, len(pages), INPUT), dtype=np.float32)
    mask = np.zeros((longest, len(pages)), dtype=np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = 1
    return x, mask


def label_pages(net: Network, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For every page, which of its blocks are main text; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        longest = len(pages[order[min(at + 63, len(order) - 1)]])
        size = max(1, min(64, BATCH_BLOCKS // longest))
        own = order[at : at + size]
        at += size
        x, mask = padded([pages[i] for i in own])
        logits = net.run(x, mask)
        for j, i in enumerate(own):
            out[i] = logits[: len(pages[i]), j] > 0
    return out


MAIN, OTHER = "\ue000", "\ue001"


def made_page(rng: random.Random) -> str:
    """A page of known blocks: each text starts with a mark that says whether it is main text."""
    syllables = "an be cor de en fi ga hu in jo ka le mo nu or pe qui ra so ta un ver wi zo é ü ñ".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def phrase(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    def prose(a: int, b: int) -> str:
        text = " ".join(phrase(3, 14) + rng.choice([".", ".", ".", "!", "?", ","]) for _ in range(rng.randint(a, b)))
        # whatever the words look like, the place decides
        style = rng.random()
        if style < 0.06:
            return text.replace(" ", " | ")
        if style < 0.12:
            return text.upper().replace(" ", "!! ")
        if style < 0.18:
            return " ".join(w + rng.choice(["###", "&&&", "***", "%%%", "$$$"]) for w in text.split(" "))
        if style < 0.22:
            return " ".join(w for w in text.split(" ") for _ in range(4))
        return text

    def other(text: str) -> str:
        return OTHER + text

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def box(tag: str, names: list[str], inside: str) -> str:
        """The element by its meaning, or a plain one whose class or id tells it."""
        kind = rng.random()
        name = rng.choice(names)
        if tag and kind < 0.55:
            own = f' class="{name}"' if rng.random() < 0.3 else ""
            return f"<{tag}{own}>{inside}</{tag}>"
        attribute = rng.choice(["class", "class", "id"])
        extra = rng.choice(["", "", f" {word()}", "-wrap", "-box", "_area"])
        return f'<{rng.choice(["div", "div", "section"])} {attribute}="{name}{extra}">{inside}</div>'

    def items(n: int) -> str:
        return "<ul>" + "".join(f"<li>{other(link(phrase(1, 3)))}</li>" for _ in range(n)) + "</ul>"

    def nav() -> str:
        return box("nav", ["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav"], items(rng.randint(2, 9)))

    def header() -> str:
        inside = rng.choice([f"<h1>{other(phrase(1, 4))}</h1>", f"<p>{other(phrase(1, 8))}</p>", other(link(phrase(1, 3)))])
        return box("header", ["header", "masthead", "banner", "topbar", "site-header"], inside + (items(3) if rng.random() < 0.4 else ""))

    def advert() -> str:
        inside = other(rng.choice([prose(1, 2), phrase(2, 8), link(phrase(2, 6))]))
        return box("", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], rng.choice([inside, f"<p>{inside}</p>"]))

    def notice() -> str:
        cue = rng.choice(["cookies", "Cookie", "privacy", "consent", "subscribe", "newsletter", "sign up"])
        inside = f"<p>{other(f'{phrase(2, 8)} {cue} {prose(1, 2)}')}</p><button>{other(phrase(1, 2))}</button>"
        return box("", ["cookie", "notice", "consent", "alert", "newsletter", "popup", "gdpr", "modal"], inside)

    def form() -> str:
        inside = f"<label>{other(phrase(1, 3))}</label><input type='text'><button>{other(phrase(1, 2))}</button>"
        return f"<form>{inside}</form>" if rng.random() < 0.7 else box("form", ["search", "login", "signup", "form", "contact"], inside)

    def aside() -> str:
        inside = f"<h3>{other(phrase(1, 3))}</h3>" + rng.choice([items(rng.randint(2, 6)), f"<p>{other(prose(1, 3))}</p>"])
        return box("aside", ["sidebar", "aside", "related", "widget", "recommended", "popular", "side"], inside)

    def comments() -> str:
        one = lambda: rng.choice(
            [
                f'<div class="{rng.choice(["comment", "reply", "comment-body"])}"><p>{other(prose(1, 3))}</p></div>',
                f"<li><b>{other(word())}</b> {prose(1, 2)}</li>",
                f'<article class="comment"><p>{other(prose(1, 3))}</p></article>',
            ]
        )
        inside = f"<h3>{other('Comments')}</h3>" + "".join(one() for _ in range(rng.randint(1, 6)))
        return f'<{(t := rng.choice(["div", "section"]))} {rng.choice(["id", "class"])}="{rng.choice(["comments", "discussion", "responses", "disqus", "replies"])}">{inside}</{t}>'

    def footer() -> str:
        cue = rng.choice(["&copy; ", "Copyright ", "© 2020 ", "&copy; "])
        inside = other(f"{cue}{word()}.{word()}.{rng.choice(['com', 'org', 'net'])} {rng.choice(['&middot; ', '| ', ''])}{prose(0, 3)}")
        return box("footer", ["footer", "foot", "bottom", "copyright", "site-footer", "legal"], rng.choice([inside, f"<p>{inside}</p>", items(3) + inside]))

    def paragraph() -> str:
        text = MAIN + rng.choice([prose(1, 6), prose(1, 6), prose(4, 12), phrase(1, 1) + ".", phrase(1, 4) + ".", phrase(5, 30).upper()])
        if rng.random() < 0.15:
            words = text.split(" ")
            i = rng.randrange(len(words))
            words[i] = rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<b>{}"]).format(words[i])
            text = " ".join(words)
        if rng.random() < 0.1:
            return rng.choice([f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{MAIN}{phrase(2, 12)}</li></ul>", f"<pre>{text}</pre>", f"<h2>{MAIN}{phrase(1, 6)}</h2>", f"<table><tr><td>{text}</td><td>{MAIN}{phrase(1, 3)}</td></tr></table>"])
        return rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}<br>", f"<div>{text}</div>"])

    body = "".join(f"<h1>{MAIN}{phrase(1, 9)}</h1>" if k == 0 and rng.random() < 0.8 else paragraph() for k in range(rng.choice([1, 2, 4, 8, 14, 30])))
    if rng.random() < 0.25:
        at = body.rfind("<p>")
        body = body[:at] + rng.choice([advert, aside, form, notice])() + body[at:] if at > 0 else body
    if rng.random() < 0.15:
        body += comments()
    main = box(rng.choice(["article", "article", "main"]), ["content", "article", "post", "entry-content", "story", "main", "article-body", "text"], body)
    if rng.random() < 0.2:
        main = f"<main>{main}</main>"
    before = [f() for f in (header, nav, notice, advert, form) if rng.random() < 0.5]
    after = [f() for f in (comments, aside, advert, form, nav, footer) if rng.random() < 0.45]
    return "<html><head><title>x</title></head><body>" + "".join(before) + main + "".join(after)


def learning_rows(pages: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of made pages."""
    rng, vectors, rows = random.Random(seed), Vectors(), []
    for _ in range(pages):
        found = [b for b in blocks(made_page(rng)) if b.text[0] in (MAIN, OTHER) and len(b.text) > 1]
        labels = np.array([b.text[0] == MAIN for b in found], dtype=np.float32)
        # a block may have gathered several marks, as it would gather several texts
        clean = [Block(b.text.replace(MAIN, "").replace(OTHER, "") or "x", b.path, b.link_chars) for b in found]
        rows.append((vectors.page(clean), labels))
    return [r for r in rows if len(r[1])]


_FITTED: dict[tuple[int, int, int], Network] = {}


def fit(pages: int = TRAIN_PAGES, passes: int = PASSES, seed: int = SEED) -> Network:
    """Backpropagation through time with Adam over made pages; fitted once per process."""
    if (pages, passes, seed) in _FITTED:
        return _FITTED[pages, passes, seed]
    rng = np.random.default_rng(seed)
    rows = learning_rows(pages, seed)

    def new(*shape: int) -> np.ndarray:
        return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

    bias = np.zeros(4 * HIDDEN, dtype=np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1  # remember by default
    net = Network(
        [new(INPUT, 4 * HIDDEN) for _ in range(2)],
        [new(HIDDEN, 4 * HIDDEN) for _ in range(2)],
        [bias.copy() for _ in range(2)],
        new(2 * HIDDEN),
        np.zeros(1, dtype=np.float32),
    )
    values = net.parameters()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, steps = 0, passes * -(-len(rows) // 32)
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            own = [rows[i] for i in order[at : at + 32]]
            x, mask = padded([p for p, _ in own])
            # on some pages the words say nothing: the place must do
            x[:, rng.random(len(own)) < WORDLESS, PATH_SIZE:] = 0
            y = np.zeros_like(mask)
            for j, (_, labels) in enumerate(own):
                y[: len(labels), j] = labels
            step += 1
            rate = 0.015 * (1 - step / (steps + 1)) + 5e-4
            for v, g, m, s in zip(values, _gradients(net, x, mask, y), first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    _FITTED[pages, passes, seed] = net
    return net

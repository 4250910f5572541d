"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags.  Every block gets a vector
of its tag path (hashed names, classes and ids of the open elements), of its words (all of them
hashed, scaled by the root of their number) and of its shape.  A bidirectional LSTM, written in numpy, reads a page's whole sequence of blocks and
labels each as main text or not, so a block is judged in the context of the document.

The network is trained here, on pages that a seeded generator composes from articles, menus,
headers, footers, sidebars, notices, adverts, forms, comments, in many layouts and with broken
markup, where the label of each block is known.  No table is read for it.  Training takes a few
seconds once per session.

Defined results: the text of a null page is empty, and so is that of a page without main text;
character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined in page order by one line break; a tag cut off by the end of the page is dropped; rows
with a repeated or null page_id are extracted on their own; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped_texts, table

PATH, WORDS, SHAPE, INNER, HIDDEN = 160, 32, 10, 32, 20
#: Blocks that the network reads at once; pages of similar length go together.
BATCH_BLOCKS = 8_192
TRAINING_PAGES, EPOCHS, BATCH, RATE = 4_000, 9, 16, 0.006

# HTML element names by role.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe object textarea math canvas".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[/a-zA-Z])[^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text: str, path: tuple[tuple[str, ...], ...], linked: float, tag: str):
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    in_link = linked = 0
    skip = ""
    start: list[tuple[str, tuple[str, ...]]] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                path = tuple(x for name, x in start if name not in _INLINE)
                tag = next((name for name, _ in reversed(start) if name not in _INLINE), "")
                out.append(Block(text, path, min(1.0, linked / len(text)), tag))
            parts.clear()
        linked = 0

    def say(s: str) -> None:
        nonlocal start, linked
        if s:
            if not parts or not any(p.strip() for p in parts):
                start = list(open_)
            parts.append(s)
            if in_link:
                linked += len(s.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if not skip:
            say(page[at : m.start()])
        name = m[2]
        at = m.end()
        if name is None:
            continue
        name = name.lower()
        closing = bool(m[1])
        if skip:
            if closing and name == skip:
                skip = ""
            continue
        if name in _RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                skip = name
            continue
        if name in _VOID:
            if name in ("br", "wbr"):
                parts.append(" ")
            elif name != "img":
                flush()
            continue
        if name not in _INLINE:
            flush()
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
            in_link = sum(n == "a" for n, _ in open_)
            continue
        same = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, ())
        if name in _CLOSES_P:
            same = ("p",)
        if same:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in same:
                    del open_[k:]
                    break
                if open_[k][0] not in _INLINE:
                    break
            in_link = sum(n == "a" for n, _ in open_)
        marks = [name]
        for key, *value in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            marks += _NAME.findall("".join(value).lower())
        open_.append((name, tuple(marks)))
        if name == "a":
            in_link += 1
    if not skip:
        say(page[at:])
    flush()
    return out


@lru_cache(maxsize=100_000)
def _slot(kind: str, word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(f"{kind}:{word}".encode())
    return h % size, 1.0 if h >> 31 else -1.0


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    v = np.zeros(PATH, dtype=np.float32)
    for depth, marks in enumerate(reversed(path)):
        for mark in marks:
            for kind in ("any",) if depth else ("any", "last"):
                i, sign = _slot(kind, mark, PATH)
                v[i] += sign
    return np.tanh(v)


#: What words a worker remembers the slots of, at most.
_REMEMBERED = 200_000
_slots: dict[str, int] = {}


def word_vector(text: str) -> np.ndarray:
    """The sum of the signed slots of all words of a block, scaled by the root of their number and bounded."""
    words = text.lower().split()
    slots = list(map(_slots.get, words))
    if None in slots:
        if len(_slots) > _REMEMBERED:
            _slots.clear()
        for k, s in enumerate(slots):
            if s is None:
                h = zlib.crc32(words[k].strip(".,;:!?()\"'").encode("utf-8", "surrogatepass"))
                slots[k] = _slots[words[k]] = h % WORDS + WORDS * (h >> 31)  # the upper half counts down
    n = np.bincount(slots, minlength=2 * WORDS)
    return np.tanh((n[:WORDS] - n[WORDS:]) / (2 * math.sqrt(max(1, len(words)))))


def vectors(page: list[Block]) -> np.ndarray:
    """One row a block: hashed tag path, hashed words, shape."""
    x = np.zeros((len(page), PATH + WORDS + SHAPE), dtype=np.float32)
    for r, b in enumerate(page):
        x[r, :PATH] = _path_vector(b.path)
        x[r, PATH : PATH + WORDS] = word_vector(b.text)
        n, c = len(b.text.split()), len(b.text)
        x[r, PATH + WORDS :] = (
            math.log1p(n) / 5, math.log1p(c) / 8, b.linked, sum(b.text.count(p) for p in ".,;") / n, b.text[-1] in ".!?", "©" in b.text,
            n < 4, len(b.path) / 10, r / len(page), b.tag in ("p", "h1", "h2"),
        )
    return x


class Labeller:
    """Input layer, LSTM in both directions, logistic output."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = PATH + WORDS + SHAPE

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)

        self.p = {"in": init(d, INNER), "inb": np.zeros(INNER, np.float32), "out": init(2 * HIDDEN + INNER, 1), "outb": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"{side}x": init(INNER, 4 * HIDDEN), f"{side}h": init(HIDDEN, 4 * HIDDEN), f"{side}c": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def _run(self, side: str, e: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """One direction over e (steps, pages, INNER); keep: gets what backward() needs."""
        steps, n, _ = e.shape
        wx, wh, bias = (self.p[side + k] for k in "xhc")
        pre = e @ wx + bias
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ wh
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            nc = m * (f * c + i * g)
            tc = np.tanh(nc)
            nh = m * (o * tc)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = nh, nc
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probability of main text; x: (steps, pages, features), mask: (steps, pages)."""
        e = np.tanh(x @ self.p["in"] + self.p["inb"])
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        both = [self._run(s, e, mask, kept[s]) for s in "fb"]
        top = np.concatenate([*both, e], axis=2)
        z = (top @ self.p["out"])[:, :, 0] + self.p["outb"]
        if keep is not None:
            keep |= {"e": e, "top": top, "runs": kept}
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        p = self.scores(x, mask, keep)
        dz = ((p - y) * mask / max(1.0, float(mask.sum())))[:, :, None].astype(np.float32)
        top, e = keep["top"], keep["e"]
        g = {"out": np.einsum("tnd,tnk->dk", top, dz), "outb": dz.sum((0, 1))}
        dtop = dz * self.p["out"][:, 0]
        de = dtop[:, :, 2 * HIDDEN :].copy()
        for s, side in enumerate("fb"):
            wx, wh = self.p[side + "x"], self.p[side + "h"]
            dwx, dwh, db = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(self.p[side + "c"])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h0, c0, i, f, o, gg, tc, m in reversed(keep["runs"][side]):
                dh = (dh + dtop[t, :, s * HIDDEN : (s + 1) * HIDDEN]) * m
                dc = dc * m + dh * o * (1 - tc * tc)
                zz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dwx += e[t].T @ zz
                dwh += h0.T @ zz
                db += zz.sum(0)
                de[t] += zz @ wx.T
                dh = zz @ wh.T
                dc = dc * f
            g |= {side + "x": dwx, side + "h": dwh, side + "c": db}
        de *= 1 - e * e
        g |= {"in": np.einsum("tnd,tnk->dk", x, de), "inb": de.sum((0, 1))}
        return g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(len(order), BATCH_BLOCKS // len(pages[order[-1]])))
            some, order = order[-n:], order[:-n]
            x, mask = _padded([pages[i] for i in some])
            p = self.scores(x, mask)
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k] >= 0.5
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH + WORDS + SHAPE), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


# ---- training pages -------------------------------------------------------------------------


# Words that are common in parts of pages that are not their main text; and words of any text.
_TYPICAL = {
    "notice": "cookies improve experience site accept decline settings consent policy subscribe newsletter updates sign free weekly inbox alert close".split(),
    "advert": "buy now sale offer limited discount sponsored advertisement shop deal save best price shipping order click promoted partner".split(),
    "form": "name email password search submit send login register message phone address required select option remember forgot".split(),
    "comments": "thanks great post reply agree comment comments nice like report anonymous guest wrote ago minutes".split(),
    "menu": "home about contact news products services blog help login sitemap archive category next previous back top".split(),
    "footer": "rights reserved privacy terms copyright imprint legal company inc ltd powered contact".split(),
    "sidebar": "related recent popular trending read tags archives recommended follow share categories links".split(),
}
_PLAIN = "the of and to in is it for on with this that we use your all you by from first more most up has der die das und le la les de des et el los un una en es".split()


class PageWriter:
    """Composes pages whose main blocks are known: each of their words begins with a mark.

    Half of the words of other parts are typical of them, and now and then the main text uses them too.
    """

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.typical: list[str] = []
        self.common = 0.2
        self.every = [w for words in _TYPICAL.values() for w in words]

    def part(self, kind: str, write) -> str:
        """What write() composes with the words of one part of a page."""
        before, self.typical = self.typical, _TYPICAL[kind] if self.r.random() < 0.6 else []
        out = write()
        self.typical = before
        return out

    def word(self) -> str:
        r = self.r
        if self.typical and r.random() < 0.5:
            return r.choice(self.typical)
        if r.random() < self.common:
            return r.choice(self.every if r.random() < 0.2 else _PLAIN)
        return "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ü", "é", "ña", "sch")) for _ in range(r.randint(1, 4)))

    def words(self, n: int, junk: float = 0.0) -> str:
        return " ".join(self.word() + (self.r.choice(("###", "%%%", "!!", " |", "$$$", "&amp;&amp;")) if self.r.random() < junk else "") for _ in range(n))

    def prose(self, junk: float = 0.0) -> str:
        r = self.r
        if r.random() < 0.04:  # a word over and over, or shouting
            return f"{self.word()} " * r.choice((3, 30, 200)) if r.random() < 0.5 else self.words(r.randint(3, 40), junk).upper()
        return " ".join(self.words(r.randint(1, 14), junk).capitalize() + r.choice((".", ".", ".", "!", "?", ",")) for _ in range(r.choice((1, 1, 2, 3, 6))))

    def main(self, text: str) -> str:
        return self.MARK + text

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def classed(self, tag: str, names: tuple[str, ...], inner: str) -> str:
        r = self.r
        name = r.choice(names)
        attr = r.choice((f' class="{name}"', f' id="{name}"', f' class="{self.word()} {name}"', f" class='{name}-{r.choice(('box', 'wrap', 'area', 'inner'))}'"))
        return f"<{tag}{attr}>{inner}" + ("" if r.random() < 0.005 else f"</{tag}>")

    def article(self) -> str:
        r = self.r
        before, self.common = self.common, r.choice((0, 0.1, 0.3, 0.6, 0.9))
        out = self._article()
        self.common = before
        return out

    def _article(self) -> str:
        r = self.r
        junk = r.choice((0, 0, 0, 0.3, 0.9))
        parts = []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.main(self.words(r.randint(1, 12), junk))}</h1>")
        same = self.main(self.words(r.randint(1, 4)).capitalize() + ".") if r.random() < 0.12 else ""
        plain = r.random() < 0.4  # paragraphs alone
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14, 36))):
            k = 0 if plain else r.random()
            text = same or self.main(self.prose(junk))
            if k < 0.7:
                opened, closed = r.choice((("<p>", "</p>"), ("<p>", "</p>"), ("<p><b>", "<br>"), ("<p>", ""), ("<p><span>", "</span></p>"), ("<div>", "</div>")))
                parts.append(opened + text + closed)
            elif k < 0.78:
                parts.append(f"<h{r.randint(2, 4)}>{self.main(self.words(r.randint(1, 6)))}</h2>".replace("</h2>", f"</h{parts and 2}>") if r.random() < 0.1 else f"<h2>{self.main(self.words(r.randint(1, 6)))}</h2>")
            elif k < 0.86:
                tag = r.choice(("ul", "ol"))
                parts.append(f"<{tag}>" + "".join(f"<li>{self.main(self.words(r.randint(1, 10)))}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif k < 0.91:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif k < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{self.main(self.words(2))}</td><td>{self.main(self.words(1))}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<pre>{text}</pre>")
            if r.random() < 0.06:
                parts.append(self.advert())
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.5:
            return f"<article>{inner}</article>" if r.random() < 0.8 else self.classed("article", ("post", "entry", "story"), inner)
        if kind < 0.65:
            return f"<main>{inner}</main>"
        if kind < 0.98:
            return self.classed(r.choice(("div", "section")), ("content", "article", "post", "entry", "main", "story", "text", "body"), inner)
        return f"<div>{inner}</div>"

    def menu(self) -> str:
        return self.part("menu", self._menu)

    def _menu(self) -> str:
        r = self.r
        items = "".join(f"<li>{self.link(self.words(r.randint(1, 3)))}</li>" for _ in range(r.randint(2, 9)))
        inner = f"<ul>{items}</ul>" if r.random() < 0.8 else " ".join(self.link(self.word()) for _ in range(r.randint(2, 6)))
        return f"<nav>{inner}</nav>" if r.random() < 0.6 else self.classed("div", ("menu", "nav", "navbar", "breadcrumb", "navigation"), inner)

    def header(self) -> str:
        inner = self.r.choice((f"<h1>{self.words(2)}</h1>", f"<p>{self.words(4)}</p>", self.menu(), self.link(self.word()), f"<div>{self.words(3)}</div>"))
        return f"<header>{inner}</header>" if self.r.random() < 0.7 else self.classed("div", ("header", "masthead", "top", "banner", "logo"), inner)

    def footer(self) -> str:
        return self.part("footer", self._footer)

    def _footer(self) -> str:
        r = self.r
        inner = r.choice(("&copy; ", "", "&copy; ")) + r.choice((f"{self.word()}.example.com &middot; {self.prose()}", f"<p>{self.prose()}</p>", self.menu(), self.words(5)))
        return f"<footer>{inner}</footer>" if r.random() < 0.7 else self.classed("div", ("footer", "copyright", "legal", "bottom"), inner)

    def advert(self) -> str:
        return self.part("advert", self._advert)

    def _advert(self) -> str:
        inner = self.r.choice((self.prose(), f"<p>{self.prose()}</p>", self.link(self.words(4)), f"<h3>{self.words(3)}</h3><p>{self.prose()}</p>"))
        return self.classed(self.r.choice(("div", "div", "aside", "section", "p")), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"), inner)

    def sidebar(self) -> str:
        return self.part("sidebar", self._sidebar)

    def _sidebar(self) -> str:
        r = self.r
        inner = r.choice((f"<h3>{self.words(2)}</h3>", "")) + r.choice((f"<ul>{''.join(f'<li>{self.link(self.words(3))}</li>' for _ in range(r.randint(1, 6)))}</ul>", f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p><p>{self.prose()}</p>"))
        return f"<aside>{inner}</aside>" if r.random() < 0.5 else self.classed("div", ("sidebar", "related", "widget", "recommended", "trending", "more"), inner)

    def notice(self) -> str:
        return self.part("notice", self._notice)

    def _notice(self) -> str:
        inner = self.r.choice((self.prose(), f"<p>{self.prose()}</p>", f"{self.prose()} <button>{self.word()}</button>"))
        return self.classed(self.r.choice(("div", "section", "p")), ("cookie", "notice", "consent", "alert", "popup", "newsletter", "subscribe", "banner", "gdpr"), inner)

    def form(self) -> str:
        return self.part("form", self._form)

    def _form(self) -> str:
        r = self.r
        inner = "".join(r.choice((f"<label>{self.words(2)}</label><input type=text>", f"<button>{self.word()}</button>", f"<select><option>{self.word()}<option>{self.word()}</select>", f"<p>{self.prose()}</p>", f"{self.words(3)} <input>")) for _ in range(r.randint(1, 4)))
        return f"<form action='/x'>{inner}</form>"

    def comments(self) -> str:
        return self.part("comments", self._comments)

    def _comments(self) -> str:
        r = self.r
        one = lambda: r.choice((f"<p>{self.prose()}</p>", f"<div><b>{self.word()}</b> <p>{self.prose()}</p></div>", f"<li>{self.prose()}</li>"))
        inner = r.choice((f"<h2>{self.words(1)}</h2>", "")) + "".join(one() for _ in range(r.randint(1, 6)))
        return self.classed(r.choice(("div", "section", "ul", "ol")), ("comments", "comment", "replies", "discussion", "responses", "reply"), inner)

    def page(self) -> str:
        r = self.r
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.form, self.advert, self.sidebar) if r.random() < 0.35]
        if r.random() < 0.4:
            before = [self.menu(), *before]
        after = [f() for f in (self.comments, self.sidebar, self.advert, self.form, self.notice, self.menu) if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.75:
            after.append(self.footer())
        body = [*before, self.article(), *after]
        if r.random() < 0.3:
            k = r.randint(0, len(before))
            body = [*body[:k], f"<div class={r.choice(('page', 'wrapper', 'container', 'layout'))}>", *body[k:], "</div>"]
        head = f"<title>{self.words(5)}</title>" + r.choice(("", "<style>p{margin:0}</style>", "<script>var x='<p>';</script>"))
        text = f"<!DOCTYPE html><html><head>{head}</head><body>{''.join(body)}</body></html>"
        return text[: int(len(text) * r.uniform(0.6, 1))] if r.random() < 0.1 else text


def training_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(block vectors, labels) of n composed pages."""
    w = PageWriter(seed)
    out = []
    while len(out) < n:
        found = blocks(w.page())
        y = np.array([PageWriter.MARK in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace(PageWriter.MARK, "") or "x"
        if len(found):
            out.append((vectors(found), y))
    return out


@lru_cache(maxsize=2)
def trained(seed: int = 5) -> Labeller:
    """A labeller trained with Adam on composed pages; the same for the same seed."""
    pages = sorted(training_pages(TRAINING_PAGES, seed), key=lambda p: len(p[0]))
    model = Labeller()
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    groups = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
    step, total = 0, EPOCHS * len(groups)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(groups)):
            x, mask = _padded([p[0] for p in groups[k]])
            y = np.zeros_like(mask)
            for j, p in enumerate(groups[k]):
                y[: len(p[1]), j] = p[1]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, g in model.gradients(x, y, mask).items():
                g = np.clip(g, -1, 1)
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                model.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def extract_main(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The kept columns of every page with text and n_chars of its main blocks."""
    shared = pages.sparkSession.sparkContext.broadcast(trained().p)

    def value(htmls: list[str | None]) -> list[list]:
        model = Labeller()
        model.p = shared.value
        found = [blocks(h or "") for h in htmls]
        labels = model.label([vectors(f) for f in found])
        texts = ["\n".join(b.text for b, y in zip(f, label, strict=True) if y) for f, label in zip(found, labels, strict=True)]
        return [texts, list(map(len, texts))]

    return mapped_texts(pages, keep, html_col, [("text", T.StringType()), ("n_chars", T.LongType())], value)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"), ["page_id", "url"]).select("page_id", "url", F.col("text"), "n_chars")

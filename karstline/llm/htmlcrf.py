"""Main text of web pages by a linear-chain conditional random field.

A page is read into leaf blocks: the runs of text between block-level tags,
each with its open ancestors.  Features of a block are the names, classes and
ids of its ancestors and counts over its text; the field joins neighbouring
labels.  It is trained on labelled pages by gradient ascent on the conditional
likelihood (forward-backward) and decoded by Viterbi.  The labelled pages are
written here, by rule, in many layouts and with invented words, so nothing of
the corpus decides what is main text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from karstline.llm.common import bounded, free_names, freed, fresh_name, named, numbered, read_table, small_batches

#: Labelled pages that are written for training, and passes over them.
TRAINING_PAGES, PASSES = 500, 120
SEED = 13

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark object q s samp small span strike strong sub sup time tt u var wbr br".split())
#: All that lies in one of these belongs to the line around it.
INLINE_WHOLE = frozenset(("math", "svg"))
#: Raw text up to the close tag, or to the page's end where there is none, and up to the close tag or nothing.
RAW = frozenset("script style textarea title".split())
RAW_IF_CLOSED = frozenset("iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind closes an open element of the second, up to the nearest of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>?|<[!?/][^>]*>?""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""", re.I)
_PARTS = re.compile(r"[a-z]+")


@lru_cache(8192)
def attribute_features(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element gives to all that it holds."""
    found = [f"in:{tag}"]
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("hidden", "aria-hidden"):
            found += ["hidden"] if value != "false" else []
        else:
            found += [f"named:{x}" for x in _PARTS.findall(value)]
    return tuple(dict.fromkeys(found))


class Element:
    """An open element; ``fresh`` are those of its features that no element around it has."""

    __slots__ = ("around", "block_tag", "fresh", "own", "tag", "weight")

    def __init__(self, tag: str, own: tuple[str, ...], fresh: tuple[str, ...], around: Element | None, is_inline: bool):
        self.tag, self.own, self.fresh, self.around, self.weight = tag, own, fresh, around, None
        self.block_tag = tag if not is_inline else around.block_tag if around else ""


class Stack:
    """Open elements; every step costs by what it opens or closes, however deep the page."""

    def __init__(self):
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.given: dict[str, int] = {}
        self.whole = 0  # open elements that put all they hold in the line

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def is_inline(self, tag: str) -> bool:
        return self.whole > 0 or tag in INLINE or tag in INLINE_WHOLE

    def push(self, tag: str, own: tuple[str, ...]) -> None:
        given = self.given
        fresh = tuple(f for f in own if not given.get(f))
        for f in own:
            given[f] = given.get(f, 0) + 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(Element(tag, own, fresh, self.open[-1] if self.open else None, self.is_inline(tag)))
        self.whole += tag in INLINE_WHOLE

    def pop_to(self, place: int) -> None:
        while len(self.open) > place:
            e = self.open.pop()
            self.places[e.tag].pop()
            self.whole -= e.tag in INLINE_WHOLE
            for f in e.own:
                self.given[f] -= 1


class Block:
    """Text of a leaf block, the innermost element around it, and how much of it is link."""

    __slots__ = ("around", "linked", "parts")

    def __init__(self, around: Element | None):
        self.around, self.parts, self.linked = around, [], 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order.  Scripts, styles, text areas and the title have none.

    Everything else is read, what browsers may not show too: whether the text of a
    button or a noscript is the article's is for the field to say.
    """
    out: list[Block] = []
    stack = Stack()
    now: Block | None = None
    at = 0

    def text(part: str) -> None:
        nonlocal now
        if now is None:
            if not part or part.isspace():
                return
            now = Block(stack.open[-1] if stack.open else None)
        now.parts.append(part)
        if stack.places.get("a"):
            now.linked += len(part)

    def end_block() -> None:
        nonlocal now
        if now is not None:
            out.append(now)
            now = None

    never_closed: set[str] = set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text(html.unescape(page[at:]))
            break
        m = _TAG.match(page, start)
        if m is None:
            text(html.unescape(page[at : start + 1]))
            at = start + 1
            continue
        if start > at:
            text(html.unescape(page[at:start]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = stack.last(tag)
            if not stack.is_inline(tag):
                end_block()
            if place >= 0:
                stack.pop_to(place)
            continue
        if (tag in RAW or tag in RAW_IF_CLOSED and tag not in never_closed) and not m[0].endswith("/>"):
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if close is not None:
                at = close.start()
            elif tag in RAW:
                at = len(page)
            else:
                never_closed.add(tag)
            continue
        if tag == "br":
            text(" ")
        if not stack.is_inline(tag):
            end_block()
            place = stack.last("p")
            if place > stack.last("table", "object", "button"):
                stack.pop_to(place)
            if tag in CLOSES:
                shut, until = CLOSES[tag]
                place = stack.last(*shut)
                if place > stack.last(*(until - shut)):
                    stack.pop_to(place)
        if tag not in VOID and not m[0].endswith("/>"):
            stack.push(tag, attribute_features(tag, m[3]))
    end_block()
    return [b for b in out if b.text]


def text_features(block: Block, text: str) -> list[str]:
    """Names of the features of a block itself: its nearest block-level element and counts over its whole text."""
    n = len(text)
    found = [
        f"parent:{block.around.block_tag if block.around else ''}",
        f"size:{min(9, n.bit_length())}",
        f"links:{min(4, 5 * block.linked // max(1, sum(map(len, block.parts))))}",
        f"stops:{min(4, text.count('. ') + text.count('! ') + text.count('? ') + (text[-1] in '.!?'))}",
        f"commas:{min(3, text.count(','))}",
        f"digits:{min(3, 8 * sum(c.isdigit() for c in text) // n)}",
        "all",
    ]
    return found + [name for name, sign in (("copyright", "©"), ("bar", "|"), ("at", "@"), ("arrow", "»")) if sign in text]


def features(block: Block, text: str) -> list[str]:
    """Names of a block's features: those of all elements around it, each once, and its own."""
    found, e = text_features(block, text), block.around
    while e is not None:
        found += e.fresh
        e = e.around
    return sorted(found)


class Field:
    """Two labels in a chain: 0 apart from the article, 1 main text."""

    def __init__(self, numbers: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.numbers, self.weights, self.moves, self.first = numbers, weights, moves, first
        self.told = {f: tuple(weights[i].tolist()) for f, i in numbers.items()}

    def weigh(self, names: Iterable[str], start: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
        e0, e1 = start
        for f in names:
            w0, w1 = self.told.get(f, (0.0, 0.0))
            e0 += w0
            e1 += w1
        return e0, e1

    def around(self, element: Element | None) -> tuple[float, float]:
        """The weight of all that the elements around a block give it; each element's is found once."""
        path = []
        while element is not None and element.weight is None:
            path.append(element)
            element = element.around
        weight = element.weight if element is not None else (0.0, 0.0)
        for e in reversed(path):
            weight = e.weight = self.weigh(e.fresh, weight)
        return weight

    def label(self, blocks: list[Block], texts: list[str]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        return self.viterbi([self.weigh(text_features(b, t), self.around(b.around)) for b, t in zip(blocks, texts, strict=True)])

    def decode(self, found: list[list[str]]) -> list[int]:
        """The likeliest labels of a chain of features."""
        return self.viterbi([self.weigh(names) for names in found])

    def viterbi(self, weights: list[tuple[float, float]]) -> list[int]:
        """The likeliest labels of blocks with these weights; ties go to main text."""
        if not weights:
            return []
        (a00, a01), (a10, a11) = self.moves.tolist()
        back, best = [], None
        for e0, e1 in weights:
            if best is None:
                best = (self.first[0] + e0, self.first[1] + e1)
                continue
            s0, s1 = best
            b0, b1 = int(s1 + a10 >= s0 + a00), int(s1 + a11 >= s0 + a01)
            back.append((b0, b1))
            best = ((s1 + a10 if b0 else s0 + a00) + e0, (s1 + a11 if b1 else s0 + a01) + e1)
        label = int(best[1] >= best[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], passes: int = PASSES, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Fits the field to labelled chains of features: Adam on the mean log-likelihood, all pages at a time."""
    names = sorted({f for chain, _ in pages for x in chain for f in x})
    numbers = {f: i for i, f in enumerate(names)}
    size, n = max((len(c) for c, _ in pages), default=1), len(pages)
    used = np.zeros((n, size), bool)
    gold = np.zeros((n, size), np.int64)
    rows, cols = [], []
    for p, (chain, labels) in enumerate(pages):
        used[p, : len(chain)] = True
        gold[p, : len(chain)] = labels
        for t, x in enumerate(chain):
            rows += [p * size + t] * len(x)
            cols += [numbers[f] for f in x]
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    theta = np.zeros(2 * len(names) + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    both = used[:, 1:] & used[:, :-1]
    want = np.eye(2)[gold] * used[..., None]
    want_moves = np.einsum("ptij,pt->ij", np.einsum("pti,ptj->ptij", want[:, :-1], want[:, 1:]), both)
    for step in range(1, passes + 1):
        w, moves, first = theta[: 2 * len(names)].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        emit = np.stack([np.bincount(rows, w[cols, k], n * size) for k in (0, 1)], 1).reshape(n, size, 2)
        alpha, beta = np.zeros((n, size, 2)), np.zeros((n, size, 2))
        alpha[:, 0] = first + emit[:, 0]
        for t in range(1, size):
            alpha[:, t] = np.where(used[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + emit[:, t], alpha[:, t - 1])
        for t in range(size - 2, -1, -1):
            beta[:, t] = np.where(used[:, t + 1, None], np.logaddexp.reduce(moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        have = np.exp(alpha + beta - z[:, None, None]) * used[..., None]
        pairs = alpha[:, :-1, :, None] + moves + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        have_moves = (np.exp(pairs) * both[..., None, None]).sum(axis=(0, 1))
        miss = (want - have).reshape(-1, 2)
        grad = np.concatenate([
            np.stack([np.bincount(cols, miss[rows, k], len(names)) for k in (0, 1)], 1).ravel(),
            (want_moves - have_moves).ravel(), (want - have)[:, 0].sum(axis=0),
        ]) / max(1, n) - decay * theta
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(numbers, theta[: 2 * len(names)].reshape(-1, 2).copy(), theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy())


class Writer:
    """Writes labelled pages: main text carries the mark ``MAIN``, which is taken off again."""

    MAIN = "\ue000"
    APART = {
        "nav": ["nav", "navbar", "menu", "main-menu", "breadcrumbs", "topnav", "site-nav", "pagination"],
        "header": ["header", "site-header", "masthead", "top-bar", "banner", "branding"],
        "footer": ["footer", "site-footer", "colophon", "copyright", "legal", "bottom"],
        "aside": ["sidebar", "side-bar", "widget", "aside", "related", "related-posts", "recommended", "popular", "tags", "author-box", "trending"],
        "div": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "cookie-notice", "notice", "alert", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "share", "social", "share-buttons", "meta", "byline", "disclaimer", "paywall"],
        "section": ["comments", "comment-list", "comment", "reader-comments", "replies", "discussion", "responses", "respond", "disqus"],
    }
    BODY = ["content", "main-content", "post", "post-content", "entry", "entry-content", "article", "article-body", "story", "story-body", "text", "body", "main", "page-content"]

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        letters = "aeioubcdfghlmnprst"
        self.words = ["".join(self.rng.choice(letters) for _ in range(self.rng.randrange(2, 10))) for _ in range(400)]

    def line(self, least: int, most: int) -> str:
        w = [self.rng.choice(self.words) for _ in range(self.rng.randint(least, most))]
        style = self.rng.random()
        if style < 0.15:
            w = [x.upper() for x in w]
        elif style < 0.3:
            w = [x + self.rng.choice(["%%%", "***", "!!", "$$$"]) for x in w]
        out = (" | " if style > 0.9 else " ").join(x + ("," if self.rng.random() < 0.08 else "") for x in w)
        return out[:1].upper() + out[1:]

    def prose(self) -> str:
        if self.rng.random() < 0.12:
            return self.line(1, 8) + self.rng.choice(["", "."])
        return " ".join(self.line(3, 18) + self.rng.choice(".....!?") for _ in range(self.rng.randint(1, 6)))

    def wrap(self, tag: str, names: list[str], inner: str) -> str:
        rng = self.rng
        name = rng.choice(names)
        if tag != "div" and rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        return self._named(rng.choice([tag, "div"]), rng.choice(["class", "class", "id"]), name, inner)

    @staticmethod
    def _named(tag: str, attribute: str, name: str, inner: str) -> str:
        return f'<{tag} {attribute}="{name}">{inner}</{tag}>'

    def apart(self, kind: str) -> str:
        rng = self.rng
        links = "".join(f'<li><a href="/{i}">{self.line(1, 3)}</a></li>' for i in range(rng.randint(2, 7)))
        if kind == "nav":
            inner = f"<ul>{links}</ul>" if rng.random() < 0.7 else " | ".join(f'<a href="#{i}">{self.line(1, 2)}</a>' for i in range(4))
        elif kind == "header":
            inner = f'<a href="/">{self.line(1, 3)}</a><p>{self.line(2, 6)}</p>' + rng.choice(["", f"<ul>{links}</ul>", f"<h1>{self.line(1, 3)}</h1>"])
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "© 2020 ", ""]) + self.line(1, 4) + rng.choice([" &middot; ", " | ", "<br>"]) + self.prose() + rng.choice(["", f"<ul>{links}</ul>"])
        elif kind == "aside":
            inner = f"<h3>{self.line(1, 4)}</h3>" + rng.choice([f"<ul>{links}</ul>", f"<p>{self.prose()}</p>", f'<p>{self.prose()} <a href="x">{self.line(1, 3)}</a></p>'])
        elif kind == "div":
            inner = rng.choice([self.prose(), f"<p>{self.prose()}</p>", f'<p>{self.prose()} <a href="x">{self.line(1, 3)}</a></p>', self.line(2, 6)])
        elif kind == "form":
            return f'<form action="/s"><label>{self.line(1, 3)}</label><input name="q"><p>{self.line(2, 9)}</p></form>'
        else:
            inner = f"<h3>{self.line(1, 3)}</h3>" + "".join(f"<{t}><b>{self.line(1, 2)}</b><p>{self.prose()}</p></{t}>" for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 4)))
        return self.wrap(kind, self.APART[kind], inner)

    def control(self) -> str:
        """What stands in a page for its reader to press, or for readers without scripts."""
        return self.rng.choice([
            f"<button>{self.line(1, 3)}</button>", f"<select><option>{self.line(1, 2)}<option>{self.line(1, 2)}</select>",
            f"<noscript><p>{self.prose()}</p></noscript>", f"<template><p>{self.prose()}</p></template>",
        ])

    def main(self) -> str:
        rng, m = self.rng, self.MAIN
        parts = [f"<h1>{m}{self.line(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for i in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            x = rng.random()
            text = m + self.prose()
            if i and x < 0.08:
                parts.append(f"<h2>{m}{self.line(1, 7)}</h2>")
            elif i and x < 0.16:
                parts.append("<ul>" + "".join(f"<li>{m}{self.line(2, 12)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif i and x < 0.2:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif i and x < 0.23:
                parts.append(f"<pre>{text}</pre>")
            elif i and x < 0.26:
                parts.append("<table>" + "".join(f"<tr><td>{m}{self.line(1, 4)}</td><td>{m}{self.line(1, 4)}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.36:
                parts.append(f"<p><b>{text}<br>")
            elif x < 0.42:
                parts.append(f"<div>{text}</div>")
            elif x < 0.5:
                parts.append(f'<p>{text} <a href="/x">{self.line(1, 3)}</a> {self.line(2, 6)}.</p>')
            else:
                parts.append(f"<p>{text}</p>")
            if x > 0.95:
                parts.append(f"<p>{m}{self.line(1, 6)} <math><mi>{self.line(1, 1)}</mi><mo>=</mo><mn>{i}</mn></math> {self.line(2, 6)}</p>")
            if i and rng.random() < 0.05:
                parts.append(self.control())
            if i and rng.random() < 0.06:
                parts.append(self.apart(rng.choice(["div", "aside", "form"])))
        return "".join(parts)

    def page(self) -> str:
        rng = self.rng
        before = [self.apart(k) for k in ("header", "nav", "div", "form", "div") if rng.random() < 0.45]
        after = [self.apart(k) for k in ("aside", "section", "div", "form", "nav") if rng.random() < 0.4] + ([self.apart("footer")] if rng.random() < 0.85 else [])
        inner = self.main()
        before += [self.control() for _ in range(2) if rng.random() < 0.15]
        if rng.random() < 0.25:
            inner += self.apart(rng.choice(["section", "div", "aside"]))
        x = rng.random()
        if x < 0.45:
            body = f"<article>{inner}</article>"
        elif x < 0.6:
            body = f"<main>{inner}</main>"
        else:
            body = self._named(rng.choice(["div", "div", "section", "main", "article"]), rng.choice(["class", "class", "id"]), rng.choice(self.BODY), inner)
        if rng.random() < 0.2:
            body = f'<div class="{rng.choice(["container", "wrapper", "row", "layout", "page"])}">{body}</div>'
        return "<html><head><title>x</title></head><body>" + "".join([*before, body, *after]) + "</body></html>"


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Written pages with the label of each of their blocks."""
    writer, out = Writer(seed), []
    for _ in range(count):
        marked = writer.page()
        labels = [int(Writer.MAIN in b.text) for b in blocks_of(marked)]
        out.append((marked.replace(Writer.MAIN, ""), labels))
    return out


def fit(pages: list[tuple[str, list[int]]] | None = None, passes: int = PASSES) -> Field:
    """A field trained on labelled pages (the written ones by default); their number bounds the work."""
    pages = labelled_pages() if pages is None else pages
    chains = []
    for page, labels in pages:
        blocks = blocks_of(page)
        if blocks and len(blocks) == len(labels):
            chains.append(([features(b, b.text) for b in blocks], labels))
    return train(chains, passes)


def main_text(field: Field, page: str | None) -> str:
    """Blocks that the field labels main text, joined by newlines."""
    blocks = blocks_of(page or "")
    texts = [b.text for b in blocks]
    return "\n".join(t for t, y in zip(texts, field.label(blocks, texts), strict=True) if y)


def extract(pages: DataFrame, field: Field, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of every whole page: the columns ``keep``, then ``text string, n_chars long``.

    A row for each input row.  A null or empty page, and one without main text, has
    an empty text; broken markup is read as far as it goes; nothing is cut short, and
    a page's cost grows with its length, however deep its elements lie.  Other
    columns are left out, whatever their names; the two added ones have other names
    where a kept column has these (``free_names``).
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)
    rows = numbered(bounded(pages).select(*map(named, keep), named(html_col).alias(fresh_name("html"))))
    added = free_names(keep, "text", "n_chars")
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField(n, t) for n, t in zip(added, (T.StringType(), T.LongType()), strict=True)])

    def run(batches):
        own = shared.value
        for b in small_batches(batches):
            texts = [main_text(own, p) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(freed(run), schema).toDF(*keep, *added)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"), fit())


QUERIES = {"op3_html_text": op3_html_text}
ORACLES: dict[str, str] = {}

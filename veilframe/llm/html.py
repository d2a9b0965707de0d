r"""Main text of web pages with a recurrent block labeller.

A page is read as the sequence of its leaf blocks: the text between two block-level tags, with the
path of open tags above it. Each block becomes a vector (hashed tag path with classes, ids and roles;
hashed words; a few shape numbers) and a bidirectional LSTM in numpy labels every block with the
whole page in view. The text is the blocks labelled as content, in page order.

The model is trained here, on ``TRAIN_PAGES`` labelled pages that ``labelled_page`` makes up from
a seed (the bound is that parameter), once in the driver's process; its weights, a few hundred kB
whatever the input, are broadcast.

Scale: one pass over the pages without a shuffle. Pages of an Arrow batch are labelled together, but a page of more than
``SLICE`` blocks by itself, slice by slice from both ends. Blocks share their open tags, and a path's vector follows
from that of the block before, so time and memory are linear in the page however deeply it nests.

Defined results: null and empty html, and pages without content blocks, give the empty text and 0
code points; unclosed tags, comments, scripts and quotes run to the end of the page, as browsers read
them; repeated rows are each read; an empty table gives an empty result. Line breaks (``<br>``) and
inline tags don't end a block. Columns other than those named are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES = 480
EPOCHS = 10
HIDDEN = 16
PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 160, 48, 6
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS
SLICE = 2048

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img".split())
INLINE |= frozenset("math mfrac mi mn mo mover mrow msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no markup: it is skipped to their own end tag, or to the end of the page.
SKIPPED = "script|style|noscript|template|iframe|textarea|title"
#: Elements whose text isn't shown; it is left out while they are open, so to their own end or to that of an element around them.
SILENT = frozenset("svg select canvas audio video".split())
#: An opening of one of these ends an open element of the same group above it.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block-level openings end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<(?P<skip>{SKIPPED})(?=[\s/>])(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=skip)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


class Open(NamedTuple):
    """An open tag with its named parts, the tag around it, and the number of tags around it. Blocks share their open tags."""

    name: str
    said: tuple[str, ...]
    around: Open | None
    depth: int

    def entries(self) -> tuple[str, ...]:
        return (self.name, *self.said)


class Block(NamedTuple):
    text: str
    inside: Open | None
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        """Entries of all open tags, the outermost first."""
        tags, at = [], self.inside
        while at:
            tags.append(at.entries())
            at = at.around
        return tuple(x for entries in reversed(tags) for x in entries)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. A path entry is a tag name, or ``name=value part`` of its class, id or role. Linear in the page."""
    out: list[Block] = []
    top: Open | None = None
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    links, linked = 0, 0
    silent, depth = "", 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, top, linked))
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            linked += len(text) if links else 0

    def pop() -> str:
        nonlocal top
        name = top.name
        opened[name] -= 1
        top = top.around
        return name

    at = 0
    for m in _TAG.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["skip"] and not silent:
                close()
            continue
        name = name.lower()
        if silent:
            if name == silent:
                depth += -1 if m["end"] else not m["attrs"].endswith("/")
                silent = silent if depth else ""
                continue
            if not (m["end"] and opened[name]):
                continue
            silent = ""
        if name in SILENT:
            if not m["end"] and not (name == "svg" and m["attrs"].endswith("/")):
                silent, depth = name, 1
            continue
        if name == "br":
            pieces.append(" ")
        if name == "a":
            links = 0 if m["end"] else 1
        if name in INLINE:
            continue
        close()
        if m["end"]:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if name in ENDS_P and top and top.name == "p":
            pop()
        while top and top.name in CLOSES.get(name, ()):
            pop()
        if name not in VOID:
            values = [x for key, *value in _NAMED.findall(m["attrs"]) for x in _PART.findall("".join(value).lower())]
            top = Open(name, tuple(f"={v}" for v in values), top, top.depth + 1 if top else 0)
            opened[name] += 1
    say(page[at:])
    close()
    return out


@lru_cache(maxsize=1 << 16)
def _hash(word: str, dims: int) -> int:
    return zlib.crc32(word.encode()) % dims


class Walker:
    """The hashed path of one block after the other: only tags that close or open between two blocks are touched."""

    def __init__(self) -> None:
        self.at: Open | None = None
        self.counts = np.zeros(PATH_DIMS, np.float32)

    def _add(self, tag: Open, n: int) -> None:
        for x in tag.entries():
            self.counts[_hash(x, PATH_DIMS)] += n

    def to(self, new: Open | None) -> np.ndarray:
        old, self.at = self.at, new
        while old is not new:
            if new is None or (old is not None and old.depth >= new.depth):
                self._add(old, -1)
                old = old.around
            else:
                self._add(new, 1)
                new = new.around
        return self.counts


def vectors(page: list[Block], first: int, last: int, walker: Walker | None = None) -> np.ndarray:
    """Input vectors of blocks first .. last - 1 of a page; ``walker`` goes on from where it stands."""
    n, walker = last - first, walker or Walker()
    out, shapes = np.zeros((n, DIMS), np.float32), []
    places, columns, shares = [], [], []
    for i in range(n):
        text, inside, linked = page[first + i]
        out[i, :PATH_DIMS] = walker.to(inside)
        words = text.split()
        places += [i] * (len(words) + 1)
        columns.append(_hash("leaf " + (inside.name if inside else ""), PATH_DIMS))
        columns += [PATH_DIMS + _hash(w, WORD_DIMS) for w in words]
        shares.append(1.0)
        shares += [1 / len(words)] * len(words)
        stops = sum(map(text.count, ".,;!?"))
        shapes.append((len(words), min(1, linked / len(text)), min(1, 5 * stops / len(words)), text[-1] in ".!?:\"", (first + i) / len(page), 1))
    np.add.at(out, (np.array(places, np.int64), np.array(columns, np.int64)), np.array(shares, np.float32))
    out[:, PATH_DIMS + WORD_DIMS :] = np.array(shapes, np.float64).reshape(n, SHAPE_DIMS)
    out[:, PATH_DIMS + WORD_DIMS] = np.log1p(np.array([x[0] for x in shapes], np.float64)) / 4
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over padded batches (pages, steps, dims); gates in the order input, forget, output, candidate."""

    def __init__(self, x: np.ndarray, h: np.ndarray, b: np.ndarray):
        self.x, self.h, self.b = x, h, b

    def step(self, gates: np.ndarray, hidden: np.ndarray, cell: np.ndarray) -> tuple:
        n = self.h.shape[0]
        gates = gates + hidden @ self.h
        i, f, o = np.split(_sigmoid(gates[:, : 3 * n]), 3, axis=1)
        g = np.tanh(gates[:, 3 * n :])
        new = f * cell + i * g
        return i, f, o, g, new, o * np.tanh(new)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of every step; padding comes last and leaves the state as it is."""
        pages, steps, _ = gates.shape
        hidden, cell = (np.zeros((pages, self.h.shape[0]), np.float32) for _ in range(2))
        out = np.empty((pages, steps, self.h.shape[0]), np.float32)
        for t in range(steps):
            i, f, o, g, new, h = self.step(gates[:, t], hidden, cell)
            if keep is not None:
                keep.append((i, f, o, g, cell, new, hidden))
            on = mask[:, t, None]
            hidden, cell = np.where(on, h, hidden), np.where(on, new, cell)
            out[:, t] = hidden
        return out

    def back(self, inputs: np.ndarray, mask: np.ndarray, keep: list, d_out: np.ndarray) -> tuple:
        """Gradients of x, h and b from those of the hidden states."""
        gx, gh, gb = np.zeros_like(self.x), np.zeros_like(self.h), np.zeros_like(self.b)
        d_h, d_c = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
        for t in range(inputs.shape[1])[::-1]:
            i, f, o, g, cell, new, hidden = keep[t]
            on = mask[:, t, None]
            d_h = d_h + d_out[:, t]
            at, top = np.where(on, d_h, 0), np.tanh(new)
            c = np.where(on, d_c, 0) + at * o * (1 - top * top)
            gates = np.concatenate([c * g * i * (1 - i), c * cell * f * (1 - f), at * top * o * (1 - o), c * i * (1 - g * g)], axis=1)
            gx += inputs[:, t].T @ gates
            gh += hidden.T @ gates
            gb += gates.sum(axis=0)
            d_h, d_c = np.where(on, gates @ self.h.T, d_h), np.where(on, c * f, d_c)
        return gx, gh, gb


def _reversed(a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse, padding left last."""
    steps = np.arange(a.shape[1])
    turned = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
    return a[np.arange(len(a))[:, None], turned]


class Labeller:
    """A bidirectional LSTM with one logistic output a block."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights
        self.ahead, self.behind, self.w, self.b = Lstm(*weights[:3]), Lstm(*weights[3:6]), weights[6], weights[7]

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        one = lambda: [rng.normal(0, 0.1, (DIMS, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)]
        return cls([w.astype(np.float32) for w in (*one(), *one(), rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1))])

    def scores(self, inputs_ahead: np.ndarray, inputs_behind: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores above 0 mean content; inputs are the gates' inputs (pages, steps, 4 * HIDDEN) of each direction."""
        mask = np.arange(inputs_ahead.shape[1]) < lengths[:, None]
        ahead = self.ahead.run(inputs_ahead, mask)
        behind = _reversed(self.behind.run(_reversed(inputs_behind, lengths), mask), lengths)
        return np.concatenate([ahead, behind], axis=2) @ self.w + self.b

    def long_scores(self, page: list[Block]) -> np.ndarray:
        """Scores of one page of any length: both directions in step, slice by slice, so that memory doesn't grow with the blocks' vectors."""
        n, scores = len(page), np.full(len(page), self.b[0], np.float32)
        inner, walkers = np.stack([self.ahead.h, self.behind.h]), (Walker(), Walker())
        hidden, cell = (np.zeros((2, HIDDEN), np.float32) for _ in range(2))
        for a in range(0, n, SLICE):
            b = min(a + SLICE, n)
            front = vectors(page, a, b, walkers[0]) @ self.ahead.x + self.ahead.b
            back = vectors(page, n - b, n - a, walkers[1])[::-1] @ self.behind.x + self.behind.b
            gates, out = np.stack([front, back], axis=1), np.empty((b - a, 2, HIDDEN), np.float32)
            for t in range(b - a):
                z = gates[t] + (hidden[:, None] @ inner)[:, 0]
                on = _sigmoid(z[:, : 3 * HIDDEN])
                cell = on[:, HIDDEN : 2 * HIDDEN] * cell + on[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                hidden = out[t] = on[:, 2 * HIDDEN :] * np.tanh(cell)
            scores[a:b] += out[:, 0] @ self.w[:HIDDEN]
            scores[n - b : n - a] += (out[:, 1] @ self.w[HIDDEN:])[::-1]
        return scores

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which blocks are content."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        while order and len(pages[order[-1]]) > SLICE:
            i = order.pop()
            out[i] = self.long_scores(pages[i]) > 0
        while order:
            group, steps = [order.pop()], 0
            steps = len(pages[group[0]])
            while order and (len(group) + 1) * steps <= 8 * SLICE:
                group.append(order.pop())
            gates = np.zeros((2, len(group), steps, 4 * HIDDEN), np.float32)
            for row, i in enumerate(group):
                x = vectors(pages[i], 0, len(pages[i]))
                for side, lstm in enumerate((self.ahead, self.behind)):
                    gates[side, row, : len(x)] = x @ lstm.x + lstm.b
            found = self.scores(gates[0], gates[1], np.array([len(pages[i]) for i in group])) > 0
            for row, i in enumerate(group):
                out[i] = found[row, : len(pages[i])]
        return out

    def gradients(self, inputs: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the blocks and its gradients in the order of ``weights``."""
        mask = np.arange(inputs.shape[1]) < lengths[:, None]
        turned, keep_a, keep_b = _reversed(inputs, lengths), [], []
        ahead = self.ahead.run(inputs @ self.ahead.x + self.ahead.b, mask, keep_a)
        behind = _reversed(self.behind.run(turned @ self.behind.x + self.behind.b, mask, keep_b), lengths)
        both = np.concatenate([ahead, behind], axis=2)
        p = _sigmoid(both @ self.w + self.b)
        d = np.where(mask, p - labels, 0).astype(np.float32) / mask.sum()
        d_both = d[:, :, None] * self.w
        loss = -np.log(np.clip(np.where(labels > 0, p, 1 - p), 1e-9, 1))[mask].mean()
        back = self.behind.back(turned, mask, keep_b, _reversed(d_both[:, :, HIDDEN:], lengths))
        grads = [*self.ahead.back(inputs, mask, keep_a, d_both[:, :, :HIDDEN]), *back, np.einsum("pt,pth->h", d, both), d.sum(keepdims=True).reshape(1)]
        return float(loss), grads


# Labelled pages for training. Words of the tag vocabulary of web pages, by what they stand for.
CONTENT_NAMES = "content article post entry story body text main page prose".split()
BOILERPLATE = {
    "nav": "nav menu navbar breadcrumb breadcrumbs links toc".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo".split(),
    "aside": "sidebar widget related recommended trending side rail".split(),
    "footer": "footer copyright legal foot bottom colophon".split(),
    "header": "header masthead top branding logo site".split(),
    "notice": "cookie notice consent gdpr alert popup modal overlay banner".split(),
    "form": "form search newsletter subscribe login signup".split(),
    "comments": "comments comment reply replies discussion responses".split(),
    "share": "share social pagination pager tags meta".split(),
}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts: list[str] = []
        self.labels: list[bool] = []
        letters = self.r.choice(["etaoinshrdlucm", "enisratdhulcgmöüäß", "eaosrnidlctumpóíñá", "esaitnrulodcméèàç"])
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) for _ in range(300)]

    def sentence(self, low: int, high: int) -> str:
        words = self.r.choices(self.words, k=self.r.randint(low, high))
        return " ".join(words).capitalize() + self.r.choice(["", ".", ".", ".", "!", "?", ":"] if low < 6 else [".", ".", ".", "!"])

    def leaf(self, tag: str, text: str, content: bool, attrs: str = "") -> None:
        inner = text
        if self.r.random() < 0.15 and " " in text:
            a, b = text.split(" ", 1)
            inner = self.r.choice([f"<b>{a}</b> {b}", f"<em>{a} {b}</em>", f'<a href="/{a}">{a}</a> {b}', f"{a}<br>{b}", f"<b>{a} {b}"])
        self.parts.append(f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if tag != "p" or self.r.random() < 0.85 else ""))
        self.labels.append(content)

    def named(self, names: list[str]) -> str:
        if self.r.random() < 0.1:
            return ""
        name = self.r.choice(names) + self.r.choice(["", "", "", "-inner", "_box", " wide", "-1"])
        return f' {self.r.choice(["class", "class", "class", "id", "role"])}="{name}"'

    def boilerplate(self, kind: str) -> None:
        r, names = self.r, BOILERPLATE[kind]
        own = {"nav": "nav", "aside": "aside", "footer": "footer", "header": "header", "form": "form"}.get(kind)
        tag = own if own and r.random() < 0.65 else r.choice(["div", "section", "div"])
        attrs = self.named(names) if tag != own or r.random() < 0.5 else ""
        attrs = attrs or ("" if tag == own else f' class="{r.choice(names)}"')
        self.parts.append(f"<{tag}{attrs}>")
        for _ in range(r.randint(1, 5) if kind == "comments" else r.randint(1, 2)):
            shape = r.random()
            if kind in ("nav", "share", "aside") and shape < 0.75:
                self.parts.append("<ul>")
                for _ in range(r.randint(2, 8)):
                    self.leaf("li", f'<a href="/x">{self.sentence(1, 2 if kind != "aside" else 8).strip(".!?:")}</a>', False)
                self.parts.append("</ul>")
            elif kind == "form":
                self.leaf(r.choice(["p", "div", "label", "button", "h3", "legend"]).replace("label", "div"), self.sentence(1, 9), False)
                self.parts.append('<input name="q">')
            elif kind in ("comments", "aside", "ad", "notice") and shape < 0.75:
                self.leaf(r.choice(["p", "p", "div", "h3", "li"]), self.sentence(3, 40 if kind == "comments" else 18), False)
            else:
                start = self.sentence(1, 12)
                self.parts.append(f"<hr>&copy; {start} &middot; {self.sentence(2, 9)}")
                self.labels.append(False)
                self.parts.append("<hr>")
        self.parts.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        wraps = [r.choice(["article", "article", "main", f'div class="{r.choice(CONTENT_NAMES)}"', "section", "div"])]
        if r.random() < 0.3:
            wraps.insert(0, r.choice(["main", "div", 'div class="container"', 'div id="wrapper"']))
        self.parts += [f"<{w}>" for w in wraps]
        if r.random() < 0.9:
            self.leaf(r.choice(["h1", "h1", "h1", "h2"]), self.sentence(2, 12).rstrip("."), True)
        for _ in range(r.randint(1, 14)):
            shape = r.random()
            if shape < 0.8:
                text = self.sentence(1, 12) if r.random() < 0.25 else " ".join(self.sentence(6, 20) for _ in range(r.randint(1, 7)))
                self.leaf("p" if r.random() < 0.93 else r.choice(["div", "pre", "blockquote"]), text, True)
            elif shape < 0.9:
                self.leaf(r.choice(["h2", "h3", "h4"]), self.sentence(1, 7).rstrip("."), True)
            elif shape < 0.96:
                self.parts.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.leaf("li", self.sentence(3, 18), True)
                self.parts.append("</ul>")
            else:
                self.boilerplate(r.choice(["ad", "share", "notice"]))
        self.parts += [f"</{w.split()[0]}>" for w in reversed(wraps)]

    def page(self) -> str:
        r = self.r
        before = [k for k, p in (("notice", 0.25), ("header", 0.4), ("nav", 0.8), ("ad", 0.45), ("form", 0.15), ("aside", 0.15)) if r.random() < p]
        after = [k for k, p in (("share", 0.25), ("comments", 0.3), ("aside", 0.3), ("ad", 0.25), ("form", 0.15), ("nav", 0.1), ("footer", 0.85)) if r.random() < p]
        self.parts.append("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style></head><body>")
        for kind in before:
            self.boilerplate(kind)
            if r.random() < 0.2:
                self.parts.append("<!-- x --><script>var t='</p>';</script>")
        if r.random() < 0.95:
            self.article()
        for kind in after:
            self.boilerplate(kind)
        self.parts.append(r.choice(["</body></html>", ""]))
        return "".join(self.parts)


def labelled_page(seed: int) -> tuple[list[Block], np.ndarray]:
    """A made-up page's blocks and which of them are content."""
    w = _Writer(seed)
    found = blocks(w.page())
    if len(found) != len(w.labels):
        raise AssertionError(f"page {seed}: {len(found)} blocks, {len(w.labels)} labels")
    return found, np.array(w.labels, np.float32)


@lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 1) -> Labeller:
    """The labeller, fitted by Adam on ``pages`` made-up pages."""
    data = [labelled_page(seed * 1_000_000 + i) for i in range(pages)]
    data = [(vectors(found, 0, len(found)), labels) for found, labels in data if found]
    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    mean, square, turn, batch = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0, 24
    for epoch in range(epochs):
        ranked = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][1]) // 12)
        groups = [ranked[i : i + batch] for i in range(0, len(ranked), batch)]
        for g in rng.permutation(len(groups)):
            rows = [data[i] for i in groups[g]]
            lengths = np.array([len(y) for _, y in rows])
            x = np.stack([np.pad(v, ((0, lengths.max() - len(v)), (0, 0))) for v, _ in rows])
            y = np.stack([np.pad(v, (0, lengths.max() - len(v))) for _, v in rows])
            _, grads = model.gradients(x, lengths, y)
            turn += 1
            rate = 0.01 * (1 - epoch / epochs)
            for w, m, s, d in zip(model.weights, mean, square, grads, strict=True):
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                w -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-7)
    return model


def _extractor(sent):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(sent.value)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                pages = [blocks(x.as_py() or "") for x in part["_html"]]
                texts = ["\n".join(p.text for p, on in zip(page, kept, strict=True) if on) for page, kept in zip(pages, model.label(pages), strict=True)]
                columns = [part.column(j) for j, n in enumerate(part.schema.names) if n != "_html"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts)], [*[n for n in part.schema.names if n != "_html"], "text"])

    return extract


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, then text: one row a page."""
    spark: SparkSession = pages.sparkSession
    sent = spark.sparkContext.broadcast(trained().weights)
    rows = pages.select(*keep, F.col(html).alias("_html"))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["text string"])
    return rows.mapInArrow(_extractor(sent), schema)

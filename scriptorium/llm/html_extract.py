"""Main text of HTML pages by minimum-cut labelling.

A page is cut into text blocks. A log-linear classifier over a block's tag, the
nearest ancestor that speaks for either label, ancestors' class names, link density and length gives each block a cost
for either label: these are the capacities to the two terminals. Its weights are fitted
on blocks of pages that mark their own article, that element hidden from half of them,
around a prior set by hand, which alone speaks where no page marks one. Neighbours in
page order and neighbours below the same section of the DOM are joined by
smoothness edges. A name of boilerplate is taken for what it says only below it, never
past the page's principal article (the article or main element with most text), and
not at all where most of the page stands below it; names of states ("has-sidebar") and
names on single paragraphs other than adverts' say nothing. The maximum flow's cut, which is the cheapest labelling,
separates content from boilerplate.

A null or empty page has no block and an empty text, as has a page without any
content block. Comments, scripts, styles and markup never become text. Unclosed
tags and truncated references are read as browsers do, near enough; pages are
read whole.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import minimise, sigmoid

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: HTML elements by kind.
RAW = {"script", "style", "noscript", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}  # text without markup, up to their own end
SKIPPED = {"template", "select", "button", "datalist", "canvas", "audio", "video"}  # controls and what is shown only if a medium is not
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SECTION = {"article", "main", "section", "nav", "aside", "header", "footer", "form", "body"}
INSIDE = {"article", "main"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
GOOD_NAMES = {"article", "content", "post", "entry", "story", "main", "text", "prose"}
BAD_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "footer", "header", "masthead", "copyright", "legal", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "comment", "comments", "disqus", "reply", "replies", "respond", "pagination", "pager", "tags", "toolbar", "complementary", "contentinfo", "hidden"}


#: Names on a single paragraph, heading or item that count.
LEAF_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "cookie", "cookies", "breadcrumb", "breadcrumbs", "copyright", "hidden"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "tr", "figcaption", "caption"}
#: First and last parts of names that speak of a state, not of what an element holds.
STATES_FIRST, STATES_LAST = {"has", "with", "without", "no", "is", "not", "js", "can"}, {"open", "opened", "closed", "active", "visible", "enabled", "disabled", "fixed", "sticky", "loaded", "on", "off"}


@dataclass(frozen=True)
class Weights:
    """Log-odds of content; the two smoothness capacities. By hand, in order of how sure each sign is: the prior of ``fit``."""

    base: float = -0.4
    inside: float = 3.0  # article or main
    outside: float = -4.0  # nav, header, footer, aside, form, menu
    good_name: float = 1.0
    bad_name: float = -6.0  # times 1 for a whole name, 3/4 for a part of one
    heading: float = 0.8
    paragraph: float = 0.8
    item: float = -0.4
    links: float = -2.5  # times the share of linked characters
    words: float = 0.25  # times log2 of words, at most 8
    sentence: float = 0.5
    adjacent: float = 0.4
    section: float = 0.4


#: The fitted weights, in the order of ``signs``.
SIGNS = ("base", "inside", "outside", "good_name", "bad_name", "heading", "paragraph", "item", "links", "words", "sentence")


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[int, ...]  # numbers of the open elements
    section: int
    linked: float
    good: bool
    inside: bool = False
    outside: bool = False
    bad: float = 0.0
    principal: bool = False


@dataclass
class _Open:
    tag: str
    number: int
    section: int
    good: bool
    heads: bool = False  # a header below it is the content's own


_NAMES: dict[tuple[str, bool], tuple[bool, float]] = {}


def _names(attributes: str, tag: str, heads: bool = False) -> tuple[bool, float]:
    """Whether class, id and role have a name of content, and how surely one of boilerplate (1: whole, 0.75: in part).
    ``heads``: a header belongs to the content."""
    if not attributes or attributes.isspace():
        return False, 0.0
    key = (attributes, heads, tag in LEAVES)
    got = _NAMES.get(key)
    if got is None:
        good, bad = False, 0.0
        listed = LEAF_NAMES if tag in LEAVES else BAD_NAMES - ({"header"} if heads else set())
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and value == "true":
                bad = 2.0
            for token in value.split():
                parts = [x.lower() for x in NAME.findall(token)]
                if not parts or parts[0] in STATES_FIRST or len(parts) > 1 and parts[-1] in STATES_LAST:
                    continue
                good = good or bool(GOOD_NAMES & set(parts))
                if "".join(parts) in listed or len(parts) == 1 and parts[0] in listed:
                    bad = max(bad, 1.0)
                elif parts[-1] in listed or parts[0] in listed:
                    bad = max(bad, 0.75)
        if len(_NAMES) >= 20_000:
            _NAMES.clear()
        got = _NAMES[key] = (good, bad)
    return got


def _placed(out: list[Block], element: dict[int, tuple[str, float, bool]]) -> list[Block]:
    """What a block's ancestors say of it, now that it is known how much of the page each holds."""
    below: dict[int, int] = {}
    for b in out:
        for n in b.path:
            below[n] = below.get(n, 0) + len(b.text)
    whole = below.get(0, 0)
    articles = [n for n in below if n and element[n][0] in INSIDE]
    principal = max(articles, key=lambda n: (below[n], -n), default=0)
    for b in out:
        for n in b.path:
            if not n:
                continue
            tag, bad, outer = element[n]
            if n == principal:
                b.inside, b.outside, b.bad, b.principal = True, False, 0.0, True
            elif tag in INSIDE:
                b.inside = b.inside or not b.outside
            if outer:
                b.inside, b.outside = False, True
            if bad > 1 or n != principal and 2 * below[n] <= whole:
                b.bad = max(b.bad, min(bad, 1.0))
    return out


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack = [_Open("", 0, 0, False)]
    element: dict[int, tuple[str, float, bool]] = {}  # tag, surety of a bad name, whether it stands outside of content
    number, links, parts, linked, length = 0, 0, [], 0, 0

    def flush() -> None:
        nonlocal parts, linked, length
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.tag, tuple(o.number for o in stack), top.section, linked / max(length, 1), top.good))
            parts, linked, length = [], 0, 0

    at, n = 0, len(html)
    skipped, nested, opened = "", 0, 0  # the element that is passed over; elements of its name, and blocks, open in it
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        if skipped:
            tag = (m[2] or "").lower()
            if tag in RAW and not m[1]:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            elif tag == skipped:
                nested += -1 if m[1] else 1
                skipped = skipped if nested else ""
            elif tag in BLOCK and tag not in VOID:
                opened += -1 if m[1] else 1
                if opened < 0:  # its parent ends: it was never closed
                    skipped, at = "", m.start()
            continue
        if m[4] is not None:
            text = unescape(m[4])
            parts.append(text)
            size = len(text.strip())
            length += size
            linked += size if links else 0
            continue
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            parts.append(" ")
        elif tag in SKIPPED:
            if not closing and not m[3].endswith("/"):
                skipped, nested, opened = tag, 1, 0
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            links = 0
            if closing:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if k:
                    del stack[k:]
                continue
            if stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
                stack.pop()
            if tag == "hr":
                continue
            number += 1
            top = stack[-1]
            good, bad = _names(m[3], tag, top.heads)
            outer = tag in OUTSIDE and not (top.heads and tag == "header")  # an article's own header holds its title
            element[number] = (tag, 0.0 if tag == "body" else bad, outer)
            heads = tag in INSIDE or top.heads and not outer
            stack.append(_Open(tag, number, number if tag in SECTION or good or bad else top.section, top.good or good, heads))
    flush()
    return _placed(out, element)


def signs(b: Block) -> tuple[float, ...]:
    return (
        1.0, b.inside, b.outside, b.good, b.bad, len(b.tag) == 2 and b.tag[0] == "h", b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "td", "dd", "dt", "th"),
        b.linked, min((b.text.count(" ") + 1).bit_length(), 8), b.text[-1] in ".!?:\"'”»",
    )


def log_odds(b: Block, w: Weights) -> float:
    return sum(x * getattr(w, name) for name, x in zip(SIGNS, signs(b), strict=True))


@dataclass
class Graph:
    """Terminal capacities as one signed supply per node, undirected edges as residual pairs."""

    supply: list[float]
    to: list[int] = field(default_factory=list)
    room: list[float] = field(default_factory=list)
    arcs: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.arcs = [[] for _ in self.supply]

    def edge(self, a: int, b: int, capacity: float) -> None:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [capacity, capacity]

    def cut(self, least: float = 1e-9) -> list[bool]:
        """True on the source's side of a minimum cut: flow is sent along shortest paths, level graph by level graph."""
        left = list(self.supply)
        while True:
            level = [0 if v > least else -1 for v in left]
            queue = deque(i for i, v in enumerate(left) if v > least)
            reached = False
            while queue:
                i = queue.popleft()
                for k in self.arcs[i]:
                    j = self.to[k]
                    if self.room[k] > least and level[j] < 0:
                        level[j] = level[i] + 1
                        reached = reached or left[j] < -least
                        queue.append(j)
            if not reached:
                return [x >= 0 for x in level]
            tried = [0] * len(left)
            for s in [i for i, v in enumerate(left) if v > least]:
                path: list[int] = []
                i = s
                while left[s] > least:
                    if left[i] < -least:
                        sent = min([left[s], -left[i], *(self.room[k] for k in path)])
                        for k in path:
                            self.room[k] -= sent
                            self.room[k ^ 1] += sent
                        left[s] -= sent
                        left[i] += sent
                        path, i = [], s
                        continue
                    while tried[i] < len(self.arcs[i]):
                        k = self.arcs[i][tried[i]]
                        if self.room[k] > least and level[self.to[k]] == level[i] + 1:
                            break
                        tried[i] += 1
                    if tried[i] < len(self.arcs[i]):
                        path.append(self.arcs[i][tried[i]])
                        i = self.to[path[-1]]
                    elif path:
                        i = self.to[path.pop() ^ 1]
                        tried[i] += 1
                    else:
                        break


def content(found: list[Block], w: Weights = Weights()) -> list[bool]:
    graph = Graph([log_odds(b, w) for b in found])
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            near = 1.0 if found[i - 1].section == b.section else 0.25
            graph.edge(i - 1, i, w.adjacent * near)
        j = last.get(b.section)
        if j is not None:
            graph.edge(j, i, w.section)
        last[b.section] = i
    return graph.cut()


def extract(html: str | None, w: Weights = Weights()) -> str:
    found = blocks(html or "")
    return "\n".join(b.text for b, kept in zip(found, content(found, w), strict=True) if kept)


#: Pages that ``fit`` learns from at most, and the longest of them in characters.
SAMPLE, SAMPLE_CHARS = 400, 200_000


def labelled(html: str | None, hidden: bool) -> tuple[list[tuple[float, ...]], list[int]]:
    """Signs and labels of the blocks of a page with an article: 1 for what stands in it, outside of boilerplate.
    ``hidden``: as if the elements that say inside or outside were plain ones."""
    found = blocks(html or "")
    if not any(b.principal for b in found):
        return [], []
    y = [int(b.principal and not b.outside and not b.bad) for b in found]
    for b in found:
        if hidden:
            b.inside = b.outside = False
    return [tuple(map(float, signs(b))) for b in found], y


def fit(pages: DataFrame, prior: Weights = Weights(), strength: float = 30.0) -> Weights:
    """Weights by penalised likelihood around ``prior``, from at most ``SAMPLE`` pages of bounded length.

    Pages without an article or main element teach nothing; without any, the prior is returned. The smoothness stays.
    """
    short = pages.select("html", F.xxhash64("html").alias("h")).where(F.length("html").between(1, SAMPLE_CHARS))
    lowest = [r.h for r in short.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]  # numbers first, so tasks send no pages
    x, y = [], []
    rows = short.where(F.col("h") <= lowest[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if lowest else []  # `SAMPLE` pages
    for k, row in enumerate(rows):
        a, b = labelled(row.html, k % 2 == 1)
        x += a
        y += b
    start = np.array([getattr(prior, n) for n in SIGNS])
    if not y:
        return prior
    rows, labels = np.array(x), np.array(y, float)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows @ w
        gap = w - start
        value = np.logaddexp(0, z).sum() - labels @ z + strength / 2 * gap @ gap
        return float(value), rows.T @ (sigmoid(z) - labels) + strength * gap

    return replace(prior, **dict(zip(SIGNS, minimise(loss, start).tolist(), strict=True)))


def main_text(pages: DataFrame, w: Weights = Weights()) -> DataFrame:
    """page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), w) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

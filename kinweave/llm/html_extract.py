"""HTML extraction: a page's main text, block by block.

1. Markup. A page is cut into flat text blocks at block-level tags. Scripts, styles and other contents that are no text
   are skipped, and blocks inside a part that its tags or class names declare to be a menu, header, footer, sidebar, notice,
   advert, form or comments are no candidates; no text statistics could tell a reader's comment from a paragraph.
2. Classification. Every other block has its number of words and its link density (the share of words inside links), the
   same of the blocks before and after it, and whether it is a heading, a list item, or inside an article element. A
   decision tree trained on the small labelled table below decides on these; the chosen blocks are joined.

A part is declared by the words of its class, id and role, split at spaces, hyphens, underscores and humps: one word that
names an aside decides (``comment-body``, ``main-menu``), whatever else is there; words after has, with, no, without, hide
or show say nothing about the part itself.

Contract: null and empty pages give empty text, with no blocks. Character references are decoded, white space in a
block becomes one space, blocks are joined by one space in page order. Broken markup (open comments, scripts, quotes or
tags) never fails: an open script or comment runs to the end of the page. Elements of other names, custom ones too, are
blocks without a meaning of their own. Pages are read whole, however long; every row is returned, repeated ones too, each judged by its own html.
Other columns stay as they are, but ``text`` and ``n_chars`` give way to the results; nothing is cut or capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm._spark import columns, map_arrow

# Names of HTML elements by how they are treated.
_SILENT = "script|style|title|noscript|template|iframe|textarea"
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_ASIDE = frozenset("nav footer aside form header menu dialog head svg math object select button canvas audio video".split())
_MAIN = frozenset(["article", "main"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# Words of class, id and role that declare a part which is not main text, and those that declare main text.
_ASIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner banners
    cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe signup login
    sidebar side aside nav navigation navbar menu menus breadcrumb breadcrumbs footer foot masthead header topbar
    comment comments commentlist disqus replies respond related recommended share sharing social widget widgets toolbar
    pager pagination search tags hidden contentinfo complementary alertdialog skip""".split()
)
_MAIN_WORDS = frozenset("article main post entry story body content text".split())
_HEADER_WORDS = frozenset(["header", "masthead"])
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ABOUT_OTHERS = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|hide|show)[-_]\S*", re.I)
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_SILENT})(?=[\s/>]|\Z)[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""",
    re.S | re.I,
)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "article")
# The labelled table: pages as their blocks in order. A block is main text (+), other text (-) or in a declared part (x,
# only a neighbour); then its words, /per cent of them in links, h in a heading, i in a list item, a in an article.
LABELLED = """
x1/100i x1/100i x2/100i x1/100i x1/100i x8 +12ha +60a +1a +45a +120a +2a x4
x1/100i x1/100i x1/100i x12 +6ha +24a +38a +9a +70a +31a +5a x4
x2/100i x1/100i x9 +1ha +1a +1a +3a +250a +1a +18/20a x4
x1/100i x5 +10ha +400/2a +15ha +90a +7/60ia +8ia +6/100ia +40a +10/100a x30
+8ha +2a +3a +2a +5a +1a x6
-1/100i -1/100i -2/100i -1/100i -3/100i +7h +80 +45 +2 +60/5 +35 -4/100 -3/100 -5/90
-2/100 -1/100 -1/100 +1h +1 +55 +30 +22/10 +2
-3 -1 -2 +9h +120 +50/8 +6 +75 +4
-4/50 -2/100 -2 +5h +18i +22i +15/20i +30i +40
-6/100i -8/100i -7/100i -9/100i -5/100i +25 +33 +28/15 -6/100i -7/100i
-2 -5/40 -3 +90/3 +1 +1 +65 +3h +48 +12 -2/100 -1/100 -12/90
+4h +6 +55 +8 +70 +9h +7 +20 +2
-1/100 -1 -2 -1/100 +11h +44 +16/30 +52 +7 -1/100 -1 -2/100 -3
-10/100 -12/95 -9/100 -14/90 +6h +60 +20/25 +35 +1h +45 -20/85 -15/100
+1h +1 +40 +2
+30 +45 +2h +3 +60
+3h +2 +50 +1 -8/100 -6/100i
"""


def _features(words: np.ndarray, links: np.ndarray, heading: np.ndarray, item: np.ndarray, article: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each block of a page, from what each block has itself; links in per cent."""
    around = [np.concatenate([[0], v])[:-1] if k < 0 else np.append(v, 0)[1:] for k in (-1, 1) for v in (words, links)]
    return np.stack([words, links, *around, heading, item, article], 1)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The features of the table's candidate blocks, and whether each is main text."""
    x, y = [], []
    for page in LABELLED.strip().splitlines():
        found = [re.fullmatch(r"([-+x])(\d+)(?:/(\d+))?(h?)(i?)(a?)", b) for b in page.split()]
        rows = _features(*(np.array(c, float) for c in zip(*((m[2], m[3] or 0, bool(m[4]), bool(m[5]), bool(m[6])) for m in found), strict=True)))
        own = [i for i, m in enumerate(found) if m[1] != "x"]
        x.append(rows[own])
        y += [found[i][1] == "+" for i in own]
    return np.concatenate(x), np.array(y)


class Tree:
    """A binary decision tree: at each node a feature and threshold, at each leaf a class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1) -> None:
        self.feature, self.threshold, self.left, self.right, self.answer = [], [], [], [], []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        node = len(self.feature)
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(node)
        self.right.append(node)
        self.answer.append(bool(2 * y.sum() >= len(y)))
        best = self._split(x, y, least) if depth and 0 < y.sum() < len(y) else None
        if best:
            f, t = best
            self.feature[node], self.threshold[node] = f, t
            low = x[:, f] <= t
            self.left[node] = self._grow(x[low], y[low], depth - 1, least)
            self.right[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, float] | None:
        """The split with the least Gini impurity; the first of equals."""
        best, found = len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v))
            cost = 2 * c[:-1] * (1 - c[:-1] / n) + 2 * (c[-1] - c[:-1]) * (1 - (c[-1] - c[:-1]) / (len(v) - n))
            cost[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = np.inf
            if len(cost) and cost.min() < best:
                k = int(cost.argmin())
                best, found = float(cost[k]), (f, float(v[k] + v[k + 1]) / 2)
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.answer)[self._leaves(x)]

    def asks(self, x: np.ndarray, feature: int) -> np.ndarray:
        """Whether a row's way through the tree tests the feature."""
        above = np.zeros(len(self.feature), dtype=bool)
        for node, f in enumerate(self.feature):  # parents come first
            if f >= 0:
                above[[self.left[node], self.right[node]]] = above[node] or f == feature
        return above[self._leaves(x)]

    def _leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, threshold, left, right = map(np.array, (self.feature, self.threshold, self.left, self.right))
        while (inner := feature[node] >= 0).any():
            low = x[np.arange(len(x)), feature[node].clip(0)] <= threshold[node]
            node = np.where(inner, np.where(low, left[node], right[node]), node)
        return node


@lru_cache(maxsize=1)
def trained() -> Tree:
    return Tree(*labelled())


def declared(attributes: str) -> int:
    """What the class, id and role of an element say of its part: -1 aside (-2 a header), 1 main text, 0 nothing."""
    names = " ".join("".join(x) for x in _ATTRIBUTE.findall(attributes))
    words = {w.lower() for w in _WORD.findall(_ABOUT_OTHERS.sub(" ", names))}
    if aside := words & _ASIDE_WORDS:
        return -2 if aside <= _HEADER_WORDS else -1
    return int(bool(words & _MAIN_WORDS))


class _Page:
    """The blocks of a page: texts, and words, linked words, part (-1 aside, 1 article), item and heading of each."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.rows: list[tuple[int, int, int, int, int]] = []
        self._text: list[str] = []
        self._linked = 0
        self._open: list[tuple[str, int]] = []
        self._link = 0

    def _flush(self) -> None:
        if self._text:
            words = " ".join("".join(self._text).split())
            self._text = []
            if words:
                own = [tag for tag, _ in self._open]
                part = self._open[-1][1] if self._open else 0
                heading = int(any(t in _HEADINGS for t in own))
                self.rows.append((words.count(" ") + 1, self._linked, part, int("li" in own), heading))
                self.texts.append(words)
            self._linked = 0

    def text(self, raw: str) -> None:
        raw = unescape(raw) if "&" in raw else raw
        self._text.append(raw)
        if self._link:
            self._linked += len(raw.split())

    def opened(self, tag: str, attributes: str) -> None:
        if tag in _INLINE:
            self._link += tag == "a"
            return
        self._flush()
        if tag in _VOID:
            return
        closes = _SELF_CLOSING.get(tag)
        if closes and self._open and self._open[-1][0] in closes:
            self._open.pop()
        part = self._open[-1][1] if self._open else 0
        if tag in _ASIDE and not (tag == "header" and part > 0):
            part = -1
        elif tag in _MAIN and part == 0:
            part = 1
        if "=" in attributes and part >= 0 and tag not in ("html", "body"):
            said = declared(attributes)
            if said == -1 or said == -2 and part == 0:  # an article's own header holds its title
                part = -1
            elif said == 1:
                part = 1
        if not (attributes.endswith("/>") and tag in ("svg", "math")):
            self._open.append((tag, part))

    def closed(self, tag: str) -> None:
        if tag in _INLINE:
            self._link -= tag == "a" and self._link > 0
            return
        self._flush()
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                break

    def end(self) -> None:
        self._flush()


def blocks(html: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts of a page's blocks, their features, and whether each is a candidate."""
    page, at = _Page(), 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            page.text(html[at : m.start()])
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            if m[2]:
                page.closed(tag)
            else:
                page.opened(tag, m[4])
    if at < len(html):
        page.text(html[at:])
    page.end()
    words, linked, part, item, heading = np.array(page.rows, float).reshape(-1, 5).T
    return page.texts, _features(words, 100 * np.minimum(linked / words.clip(1), 1), heading, item, part == 1), part >= 0


def main_text(html: str | None) -> str:
    texts, features, candidates = blocks(html or "")
    if not texts:
        return ""
    return " ".join(t for t, kept in zip(texts, (candidates & trained().predict(features)).tolist(), strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but html, with text and n_chars."""
    other = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    pages = columns(pages, *other, "html")
    schema = pages.drop("html").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return map_arrow(pages, read, schema)

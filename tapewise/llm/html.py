"""Main text of web pages from flat text blocks.

A page is cut into blocks of text at its block tags. Each block is described by its own and its neighbours' word
counts and link densities, and by the kind of element that holds it; a decision tree trained on a small labelled
table says which blocks are the article."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import labelled
from .common import tuck, untuck

# Element names of the HTML standard.
SKIPPED = {"script", "style", "noscript", "template", "textarea", "select", "button", "svg", "math", "iframe", "object", "head",
           "title", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}      # their content is no markup
FRAMES = {"nav", "header", "footer", "aside", "menu", "dialog"}
BODIES = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "meter", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
HEADS = {"head", "title", "meta", "link", "base", "style", "script", "noscript", "template"}       # what a head can hold
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words in class or id names of page furniture, as whole name parts.
REMARKS = {"comment", "comments", "commentlist", "reply", "replies", "disqus", "respond", "response", "responses", "feedback", "discussion", "guestbook"}
CONTROLS = {"input", "select", "textarea", "button"}
FURNITURE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
             "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "side", "widget",
             "related", "recommended", "share", "sharing", "social", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter",
             "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "toolbar", "copyright", "disclaimer", "legal",
             "reader", "form"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
CLASSES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
UNSEEN = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    links: int          # words inside links
    words: int
    frame: bool         # inside navigation, header, footer, sidebar and the like, by element
    remark: bool        # inside reader comments, by a class name
    named: int          # the outermost element around it whose class names speak of page furniture, as a number, or -1
    form: int           # the form around it, or -1
    body: bool          # inside article or main
    paragraph: bool     # a paragraph, quotation, preformatted text, table cell or list item
    heading: bool


@lru_cache(4096)
def furniture(attributes: str, body: bool, whole: bool) -> int:
    """2 if class, id or role names speak of reader comments, 1 if of other page furniture, else 0. In an article, a header
    is its own and no furniture. An article or the whole page may say in parts of a name that it has comments or a
    sidebar: of them (`whole`) only whole names count, and only as comments."""
    given = [m[1] or m[2] or m[3] or "" for m in CLASSES.finditer(attributes)]
    if whole:
        return 2 * bool({x.lower() for g in given for x in g.split()} & REMARKS)
    names = {x for g in given for x in PARTS.split(CAMEL.sub("-", g).lower())}
    if names & REMARKS:
        return 2
    return int(bool((names - {"header"} if body else names) & FURNITURE))


class Page:
    """Text blocks in page order; what scripts, styles, controls, hidden elements and comments hold is no text. Character
    references are decoded, white space is one space. Elements that are never closed end with their parent, a page that
    breaks off ends everything. The time is linear in the page, however deep its tags are."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.named: list[int] = []          # words outside of links, by named element
        self.forms: list[list[int]] = []    # [words, controls that can be seen], by form
        self.stack: list[tuple] = []        # open elements: name, whether its text is skipped, and the state outside
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.links: list[str] = []
        self.skip, self.link, self.kind = 0, 0, ""
        self.state = (False, False, -1, -1, False)      # frame, remark, named, form, body
        self._read(html)

    def _close_block(self) -> None:
        if not self.parts:
            return
        text = SPACES.sub(" ", unescape("".join(self.parts))).strip()
        linked = len(unescape("".join(self.links)).split()) if text and self.links else 0
        self.parts.clear()
        self.links.clear()
        if not text:
            return
        frame, remark, named, form, body = self.state
        words, kind = text.count(" ") + 1, self.kind
        self.blocks.append(Block(text, linked, words, frame, remark, named, form, body, kind in ("p", "blockquote", "pre", "li", "td", "dd", "figcaption"),
                                 len(kind) == 2 and kind[0] == "h" and kind[1].isdigit()))
        if named >= 0:
            self.named[named] += max(0, words - linked)
        if form >= 0:
            self.forms[form][0] += words

    def _push(self, name: str, skipped: bool) -> None:
        self.stack.append((name, skipped, self.state))
        self.open[name] = self.open.get(name, 0) + 1
        self.skip += skipped

    def _pop(self) -> str:
        name, skipped, self.state = self.stack.pop()
        self.open[name] -= 1
        self.skip -= skipped
        return name

    def _enter(self, name: str, attributes: str) -> None:
        """An element that is no inline one."""
        frame, remark, named, form, body = self.state
        self._push(name, name in SKIPPED or bool(HIDDEN.search(attributes)))
        whole = name in BODIES or name in ("html", "body")
        if name in BODIES and not frame:        # a wrapper named after its sidebar, say
            named = -1
        frame = frame or name in FRAMES and not (name == "header" and body)
        body = body or name in BODIES
        if attributes:
            names = furniture(attributes, body, whole)
            remark = remark or names == 2
            if names == 1 and named < 0:
                named = len(self.named)
                self.named.append(0)
        if name == "form" and form < 0:
            form = len(self.forms)
            self.forms.append([0, 0])
        self.state = (frame, remark, named, form, body)

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(html, at)
            piece = html[at:m.start() if m else len(html)]
            if piece and not self.skip:
                self.parts.append(piece)
                if self.link:
                    self.links.append(piece + " ")
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name, attributes, closing = m[2].lower(), m[3] or "", m[0].endswith("/>")
            if not m[1] and name not in HEADS and self.stack and self.stack[-1][0] == "head":     # ends a head that nobody closed
                self._close_block()
                self._pop()
            if m[1]:        # an end tag
                if name == "a":
                    self.link = 0
                if name in VOID or name in INLINE and not self.open.get(name):
                    continue
                if name not in INLINE:
                    self._close_block()
                    self.kind = ""
                if self.open.get(name):
                    while self._pop() != name:
                        pass
                    if name not in INLINE:
                        self.link = 0
                        self.kind = self.stack[-1][0] if self.stack else ""
                continue
            if name in CONTROLS and self.state[3] >= 0 and not UNSEEN.search(attributes):
                self.forms[self.state[3]][1] += 1
            if name in INLINE:
                self.link = 1 if name == "a" else self.link
                hidden = bool(attributes) and bool(HIDDEN.search(attributes))
                if (hidden or self.open.get(name)) and name not in VOID and not closing:     # followed only where it hides its text
                    self._push(name, hidden)
            elif name == "br":
                self.parts.append(" ")
            elif name == "hr":
                self._close_block()
            elif name in VOID:
                continue
            else:
                self._close_block()
                if name in RAW and not closing:
                    at = re.compile(rf"</{name}\s*>|\Z", re.I).search(html, at).end()
                    continue
                if name in ("p", "li") and self.stack and self.stack[-1][0] == name:
                    self._pop()
                if name == "body":      # ends a head that nobody closed
                    while self.stack:
                        self._pop()
                if not closing:
                    self._enter(name, attributes)
                self.kind, self.link = name, 0
        self._close_block()


FEATURES = ["frame", "remark", "named", "outside", "body", "heading", "paragraph", "control_share", "named_share", "named_words", "body_share", "words",
            "link_density", "words_before", "density_before", "words_after", "density_after", "link_run", "text_near"]


def derived(x: np.ndarray) -> np.ndarray:
    """Adds the lowest link density among a block and its neighbours, and the most words of one that is no link."""
    words, density = x[:, [11, 13, 15]], x[:, [12, 14, 16]]
    return np.column_stack([x, density.min(axis=1), (words * (1 - density)).max(axis=1)])


def features(page: Page) -> np.ndarray:
    """One row of FEATURES per block.

    outside: not in the article or main element of a page that has one (an article in comments or in a frame is none).
    control_share: controls for every ten words of the form around it, 1 at most. named_share and named_words: of the text
    that is no link, what lies in the same named element. body_share: what lies in articles. The neighbours are the nearest blocks
    before and after that agree in frame, remark, named and outside; beyond them there is none of anything."""
    found = page.blocks
    n = len(found)
    flags = np.array([(b.frame, b.remark, b.named >= 0, 0, b.body, b.heading, b.paragraph) for b in found], float).reshape(n, 7)
    plain = np.array([b.words - b.links for b in found], float)
    real = (flags[:, 4] > 0) & (flags[:, 0] == 0) & (flags[:, 1] == 0)
    flags[:, 3] = real.any() * (1 - flags[:, 4])
    total = max(1.0, float(plain.sum()))
    held = np.array([page.named[b.named] if b.named >= 0 else 0 for b in found], float)
    control = np.array([min(1.0, 10 * page.forms[b.form][1] / max(1, page.forms[b.form][0])) if b.form >= 0 else 0.0 for b in found])
    around = np.column_stack([control, held / total, held, np.full(n, plain[real].sum() / total)])
    words = np.array([0, *[b.words for b in found]], float)
    density = np.array([0, *[b.links / b.words for b in found]], float)
    before, after, last = np.zeros(n, int), np.zeros(n, int), {}
    for i, b in enumerate(found):
        zone = (b.frame, b.remark, b.named, flags[i, 3])
        j = last.get(zone, 0)
        before[i] = j
        if j:
            after[j - 1] = i + 1
        last[zone] = i + 1
    return derived(np.column_stack([flags, around, words[1:], density[1:], words[before], density[before], words[after], density[after]]))


@dataclass
class Node:
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    good: bool = False


def train(x: np.ndarray, y: np.ndarray, depth: int = 16) -> Node:
    """Binary tree that splits (feature < limit) by the lowest Gini impurity until the rows agree."""
    if depth == 0 or y.all() or not y.any():
        return Node(good=bool(y.mean() >= 0.5) if len(y) else False)
    best, split = 2.0, None
    for f, column in enumerate(x.T):
        values = np.unique(column)
        for limit in (values[1:] + values[:-1]) / 2:
            high = column >= limit
            impurity = sum(part.sum() and 2 * y[part].mean() * (1 - y[part].mean()) * part.mean() for part in (high, ~high))
            if impurity < best - 1e-12:
                best, split = impurity, (f, float(limit))
    if split is None:
        return Node(good=bool(y.mean() >= 0.5))
    high = x[:, split[0]] >= split[1]
    return Node(*split, train(x[~high], y[~high], depth - 1), train(x[high], y[high], depth - 1))


def classify(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.good)
    high = x[:, node.feature] >= node.limit
    out = np.empty(len(x), bool)
    out[~high], out[high] = classify(node.low, x[~high]), classify(node.high, x[high])
    return out


def trained() -> Node:
    table = labelled()
    return train(derived(table[:, :-1]), table[:, -1] > 0)


def main_text(html: str, tree: Node) -> str:
    page = Page(html)
    good = classify(tree, features(page)) if page.blocks else []
    return "\n".join(b.text for b, g in zip(page.blocks, good) if g)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (html, other columns) without html, with `text`, the main text (empty if there is none; a null page is empty),
    and `n_chars`, its code points; columns of these names are replaced. Rows with a null or repeated page_id are pages like
    others, an empty table gives an empty one. One pass over the pages, a row at a time."""
    given = pages.drop("text", "n_chars")
    pages = tuck(given, "html")
    kept = pages.columns[1:]
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            for lo in range(0, batch.num_rows, 256):
                size = min(256, batch.num_rows - lo)
                texts = [main_text(h or "", tree) for h in column.slice(lo, size).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, size) for c in kept], pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    schema = StructType([*[pages.schema[c] for c in kept], StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.mapInArrow(run, schema).select(*untuck(pages, given, "html"), "text", "n_chars")

"""Main text of web pages by minimum-cut labelling of their blocks.

A page is a row of text blocks in a tree of elements. A linear classifier gives each block the cost of calling it content or
boilerplate, which are its edges to the two terminals; neighbours in the page, blocks of one parent and blocks of one
grandparent are tied by smoothness edges. The minimum cut, found by maximum flow, labels all blocks of a page at once.

Names of elements are evidence with a finite cost, not a veto: a word that speaks for a frame ("sidebar") costs less inside a
longer name, nothing after a word that only tells that there is one ("with-sidebar"), and little for an element that holds
nearly all of the page's text, which is then a wrapper.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from silovalue.llm import common

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|svg|select|iframe|object|canvas|audio|video|math)\b"
    rf"{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRIBUTES})>|<[!?/][^>]*>"
    r"|<(?P<loose>[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY = {
    "p": {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "nav", "footer", "header", "form", "table", "pre", "blockquote"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
NEVER = {"nav", "footer", "aside", "form", "button", "head", "menu", "dialog", "fieldset", "label", "input"}
NEVER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promoted", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "comment", "comments", "commentlist", "reply", "replies", "disqus",
    "discussion", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead",
    "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "login", "search", "widget", "toolbar",
    "toc", "skip", "copyright", "contentinfo", "complementary", "paywall", "disclaimer", "tags", "promobox", "responses",
}
MAIN = {"article", "main"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story", "articlebody", "maincontent", "body-text", "text"}
TELLS_OF = {"no", "with", "without", "has", "have", "is", "show", "hide", "toggle", "js", "not"}
# Cost of an element's tag or name, which each text below it pays to be content.
FRAME_TAG, FRAME_NAME, FRAME_ENDING, FRAME_START = 14.0, 10.0, 8.0, 1.5
WRAPPER = 0.1  # share of that cost that remains for an element around nearly everything
MOST_OF_MAIN, WITH_MAIN, WITHOUT_MAIN = 0.9, 0.4, 0.85
WRAPPING_TAGS = {"form", "fieldset", "dialog", "label"}  # whole pages stand in these
# Weights of the linear classifier on a block's features; positive speaks for content.
WEIGHTS = {
    "constant": -0.6, "in_main": 3.0, "no_main_on_page": 0.9, "words": 0.55, "ends_sentence": 0.7, "link_share": -3.5,
    "heading": 0.3, "list_item": -0.5, "paragraph": 0.8, "page_header": -3.0, "after_end": -1.0,
}
NEIGHBOURS, SIBLINGS, COUSINS = 0.35, 0.25, 0.1


class Element:
    """An open or closed element: its own cost as part of a frame, and how much text lies below it."""

    __slots__ = ("parent", "tag", "cost", "main", "header", "size", "main_size")

    def __init__(self, tag: str, parent: int, cost: float, main: bool, header: bool):
        self.tag, self.parent, self.cost, self.main, self.header = tag, parent, cost, main, header
        self.size = self.main_size = 0


class Block:
    __slots__ = ("parts", "link", "element", "text")

    def __init__(self, element: int):
        self.parts, self.link, self.element, self.text = [], 0, element, ""


def _names(attributes: str) -> set[str]:
    return {name for found in _NAMES.findall(attributes) for name in " ".join(found).lower().split()}


def _has_word(names: set[str], words: set[str]) -> bool:
    return any(name in words or not words.isdisjoint(re.split(r"[-_]+", name)) for name in names)


def frame_cost(tag: str, names: set[str]) -> float:
    """What the element's tag and names say for a frame."""
    cost = FRAME_TAG if tag in NEVER else 0.0
    for name in names:
        parts = [p for p in re.split(r"[-_]+", name) if p]
        telling = next((i for i, p in enumerate(parts) if p in TELLS_OF), None)
        said = parts if telling is None else parts[:telling]
        if not said:
            continue
        if name in NEVER_WORDS or said[-1] in NEVER_WORDS:
            cost = max(cost, FRAME_NAME if len(said) == 1 else FRAME_ENDING)
        elif not NEVER_WORDS.isdisjoint(said):
            cost = max(cost, FRAME_START if said[-1] in MAIN_WORDS else FRAME_ENDING)
    return cost


def page_blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks in page order and the elements: block-level tags start a new block, inline tags and line breaks don't."""
    elements = [Element("", 0, 0.0, False, False)]
    stack = [0]
    blocks: list[Block] = []
    now: Block | None = None
    at = open_links = 0

    def add(text: str) -> None:
        nonlocal now
        if not text or (now is None and not text.strip()):
            return
        if now is None:
            now = Block(stack[-1])
            blocks.append(now)
        now.parts.append(text)
        if open_links:
            now.link += len(text)

    def opened(tag: str, cost: float, main: bool, header: bool) -> None:
        nonlocal now
        elements.append(Element(tag, stack[-1], cost, main, header))
        stack.append(len(elements) - 1)
        now = None

    for token in _TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        if token["raw"]:
            continue
        tag = (token["tag"] or token["loose"] or "").lower()
        if not tag:
            continue
        above = elements[stack[-1]]
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                open_links = 0 if token["end"] else 1
            if not token["end"] and tag not in VOID:
                cost = frame_cost(tag, _names(token["attrs"] or "")) if token["attrs"] or tag in NEVER else 0.0
                if cost:
                    opened(tag, cost, above.main, above.header)
            elif token["end"] and above.tag == tag and len(stack) > 1:
                stack.pop()
                now = None
            continue
        now, open_links = None, 0
        if token["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if elements[stack[depth]].tag == tag:
                    del stack[depth:]
                    break
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(elements[stack[-1]].tag, ()):
            stack.pop()
        if tag in VOID:
            continue
        above = elements[stack[-1]]
        names = _names(token["attrs"] or "")
        whole = tag in ("html", "body")
        header = above.header or (not above.main and not whole and (tag == "header" or _has_word(names, {"header"})))
        opened(tag, 0.0 if whole else frame_cost(tag, names), above.main or tag in MAIN or (not whole and _has_word(names, MAIN_WORDS)), header)
    add(page[at:])
    out = []
    for block in blocks:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        if block.text:
            out.append(block)
    return out, elements


def frame_costs(blocks: list[Block], elements: list[Element]) -> list[float]:
    """Of each element with all above it; wrappers of nearly the whole page's unlinked text pay little for their names."""
    for block in blocks:
        size, e = max(0, len(block.text) - block.link), block.element
        framed, walk = False, e
        while walk and not framed:
            framed, walk = elements[walk].tag in NEVER - WRAPPING_TAGS, elements[walk].parent
        for_main = size if elements[e].main and not framed else 0
        size = 0 if framed else size
        while True:
            elements[e].size += size
            elements[e].main_size += for_main
            if not e:
                break
            e = elements[e].parent
    whole = elements[0]
    out = [0.0]
    for element in elements[1:]:
        cost = element.cost
        if cost and (element.tag not in NEVER or element.tag in WRAPPING_TAGS):
            most = element.main_size >= MOST_OF_MAIN * whole.main_size if whole.main_size else True
            if most and whole.size and element.size >= (WITH_MAIN if whole.main_size else WITHOUT_MAIN) * whole.size:
                cost *= WRAPPER
        out.append(out[element.parent] + cost)
    return out


def leaning(block: Block, element: Element, cost: float, any_main: bool, ended: bool) -> float:
    """Above 0: content."""
    n_words = block.text.count(" ") + 1
    score = WEIGHTS["constant"] + WEIGHTS["words"] * min(4.0, n_words ** 0.5) - cost
    score += WEIGHTS["link_share"] * min(1.0, block.link / max(1, len(block.text)))
    score += WEIGHTS["in_main"] if element.main else 0.0 if any_main else WEIGHTS["no_main_on_page"]
    if any_main and not element.main:
        score -= WEIGHTS["in_main"]
    score += WEIGHTS["ends_sentence"] * block.text.endswith((".", "!", "?", "…", "”", "\""))
    score += WEIGHTS["heading"] * (element.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    score += WEIGHTS["paragraph"] * (element.tag in ("p", "pre", "blockquote", "td"))
    score += WEIGHTS["list_item"] * (element.tag == "li")
    score += WEIGHTS["page_header"] * element.header
    score += WEIGHTS["after_end"] * ended
    return score


class Flow:
    """Maximum flow by shortest augmenting levels; few nodes and edges, all capacities non-negative."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, source: int) -> list[int]:
        level, queue = [-1] * len(self.edges), deque([source])
        level[source] = 0
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def cut(self, source: int, sink: int) -> list[bool]:
        """The nodes on the source's side of the minimum cut."""
        while (level := self.levels(source))[sink] >= 0:
            place = [0] * len(self.edges)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    x, path = source, []
                    continue
                while place[x] < len(self.edges[x]):
                    e = self.edges[x][place[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        break
                    place[x] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    x = self.to[e ^ 1]
                    place[x] += 1
                    continue
                path.append(e)
                x = self.to[e]
        return [v >= 0 for v in level]


def main_blocks(page: str) -> list[str]:
    blocks, elements = page_blocks(page)
    if not blocks:
        return []
    costs = frame_costs(blocks, elements)
    main = [elements[b.element].main and costs[b.element] < FRAME_ENDING for b in blocks]
    found, last = any(main), max((i for i, m in enumerate(main) if m), default=len(blocks))
    flow = Flow(len(blocks) + 2)
    source, sink = len(blocks), len(blocks) + 1
    near: dict[tuple[int, int], int] = {}
    for i, block in enumerate(blocks):
        element = elements[block.element]
        score = leaning(block, element, costs[block.element], found, i > last)
        flow.add(source, i, max(score, 0.0))
        flow.add(i, sink, max(-score, 0.0))
        if i:
            flow.add(i - 1, i, NEIGHBOURS, NEIGHBOURS)
        parent = element.parent
        for up, weight in ((1, SIBLINGS), (2, COUSINS)):
            if (up, parent) in near:
                flow.add(near[up, parent], i, weight, weight)
            near[up, parent] = i
            parent = elements[parent].parent
    return [b.text for b, kept in zip(blocks, flow.cut(source, sink)) if kept]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page from its whole html; null or empty html, or no content: empty text.

    Repeated rows and null ids keep their own rows; other columns are not read.
    """

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = ["\n".join(main_blocks(h)) if h else "" for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return common.map_batches(rows, one, "page_id bigint, url string, text string, n_chars bigint")

"""Main text of a web page by tag-path ratios.

A page is cut into blocks of text, each with the path of tags from the root to it.  Blocks of
one path look alike and mostly serve alike, so length and punctuation are summed by path:
article paragraphs have long texts with many marks on few paths, menus short ones without.
The two ratios are fused, smoothed over neighbouring blocks, and blocks above a threshold are
content nodes.  The article is the declared one around nearly all of their text; where none is
declared, the smallest element that holds all of them, widened by parents that add text of the
article's kind or its heading.  What lies in it belongs to the text, headings and short paragraphs too, unless its path is a menu's,
or an element on the way says by its tag or role that it is a menu, header, footer, sidebar or dialog.
Words in class and id, and the form tag, only propose that: an element around most of the page's
text with its heading is none, whatever it is called, nor is one of the doubtful names whose text reads like an article's.

Paths are numbers, and all passes over elements go once up or down, so time and memory grow with the page alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Smoothing weights of a block and its neighbours at distance 1 and 2.
SMOOTH = (0.4, 0.24, 0.06)
#: A block is content if its score reaches this share of the text-weighted mean.
THRESHOLD = 0.3
#: Paths with more of their text in links are menus, outside a declared article.
LINK_SHARE = 0.7
#: In one, paths of at least two blocks are menus with more text in links, blocks shorter and marks fewer than this.
MENU_LINK_SHARE, MENU_CHARS, MENU_MARKS = 0.9, 40, 0.5
#: A declared article holds this share of the content nodes' text.
COVER = 0.9
#: An element named like a page part is none if it holds this share of the page's text, or that with the heading.
MOST, MOST_WITH_HEADING = 0.9, 0.5
#: Nor is one with a doubtful name whose blocks are this long, have this many marks and fewer links.
PROSE_CHARS, PROSE_MARKS, PROSE_LINKS = 60, 1.0, 0.3

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset(
    "head title script style noscript template svg math iframe object select option button textarea input datalist".split()
)
PAGE_TAGS = frozenset("nav header footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
#: Words of class and id names that mark what is not the article.
PAGE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer foot sidebar aside widget comment comments reply replies disqus cookie "
    "cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations pagination pager toolbar skip hidden".split()
)
#: Those of them that articles about something have too.
DOUBTFUL_WORDS = frozenset("header social share sharing related recommended recommendations".split())
#: A header with one of these words is the article's own.
ARTICLE_WORDS = frozenset("post entry article story".split())
#: Tags that an open tag of the kind before ends: the p before a p, the li before a li, ...
CLOSED_BY = {
    "li": ("li", frozenset("ul ol menu dir".split())),
    "dt": ("dt dd", frozenset(["dl"])),
    "dd": ("dt dd", frozenset(["dl"])),
    "tr": ("tr td th", frozenset(["table"])),
    "td": ("td th", frozenset(["tr", "table"])),
    "th": ("td th", frozenset(["tr", "table"])),
    "option": ("option", frozenset(["select"])),
}
CLOSED_BY = {tag: (frozenset(ends.split()), within) for tag, (ends, within) in CLOSED_BY.items()}

_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z)",
    re.S,
)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)|\Z", re.I | re.S) for tag in _RAW}
_ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: A slash at the end belongs to a value without quotes, as in <a href=/>, and closes nothing.
_BARE_VALUE = re.compile(r"=\s*[^\s\"'>=]*/\s*\Z")
_NAME_PART = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


# How an element says that it is no part of the article: not at all, by a doubtful name, by name, or for certain.
_NOT, _DOUBTFUL, _NAMED, _CERTAIN = range(4)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int
    excluded: bool
    named: int = _NOT
    in_link: bool = False


@dataclass(slots=True)
class Block:
    element: int
    path: int
    excluded: bool
    parts: list[str] = field(default_factory=list)
    text: str = ""
    link_chars: int = 0
    marks: int = 0


def _page_part(tag: str, attrs: str) -> int:
    if tag in HIDDEN_TAGS or tag in PAGE_TAGS:
        return _CERTAIN
    found = _NAMED if tag == "form" else _NOT
    if "=" not in attrs and "hidden" not in attrs:
        return found
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            if tag in ("body", "html", "article", "main"):
                continue
            words = set(_NAME_PART.findall(_CAMEL.sub("-", value).lower()))
            page_words = words & PAGE_WORDS
            if words & ARTICLE_WORDS:
                page_words -= {"header"}
            if page_words:
                found = max(found, _DOUBTFUL if page_words <= DOUBTFUL_WORDS else _NAMED)
        elif name == "role" and value.lower() in PAGE_ROLES:
            return _CERTAIN
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return _CERTAIN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _CERTAIN
    # Inside a line of text there is nothing to weigh.
    return found if tag in BLOCK_TAGS or not found else _CERTAIN


class _Open:
    """The open elements: their numbers, and per tag and for all blocks the depths at which they stand."""

    def __init__(self, elements: list[Element]):
        self.elements = elements
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, number: int) -> None:
        tag = self.elements[number].tag
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        self.stack.append(number)

    def pop_to(self, depth: int) -> bool:
        """Closes what stands at this depth and above; whether that is a block."""
        closed_block = self.blocks[-1] >= depth
        while len(self.stack) > depth:
            self.depths[self.elements[self.stack.pop()].tag].pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()
        return closed_block

    def last(self, tags) -> int:
        """Depth of the last open element with one of the tags, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def first_after(self, tags, depth: int) -> int | None:
        """Depth of the first open element with one of the tags beyond a depth."""
        found = []
        for tag in tags:
            at = self.depths.get(tag, [])
            i = bisect_right(at, depth)
            if i < len(at):
                found.append(at[i])
        return min(found, default=None)

    @property
    def inner(self) -> Element:
        return self.elements[self.stack[-1]]

    @property
    def holder(self) -> int:
        """The innermost open block."""
        return self.stack[self.blocks[-1]]


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """The elements of a page and its blocks of text in page order."""
    elements = [Element("", -1, 0, False)]
    opened = _Open(elements)
    paths: dict[tuple[int, str], int] = {}
    blocks: list[Block] = []
    open_block: Block | None = None

    def add(text: str) -> None:
        nonlocal open_block
        inner = opened.inner
        if open_block is None or open_block.excluded and not inner.excluded:
            if text.isspace():
                return
            holder = opened.holder
            open_block = Block(holder, elements[holder].path, inner.excluded)
            blocks.append(open_block)
        if inner.excluded == open_block.excluded:
            open_block.parts.append(text)
            open_block.link_chars += len(text) * inner.in_link

    at = 0
    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            depth = opened.last([tag])
            # A block is not closed by an inline tag's end.
            if depth and (tag in BLOCK_TAGS or depth > opened.blocks[-1]) and opened.pop_to(depth):
                open_block = None
            continue
        if tag in BLOCK_TAGS:
            open_block = None
            # A block ends an open paragraph, and what was opened in it.
            if elements[opened.holder].tag == "p":
                opened.pop_to(opened.blocks[-1])
            ends, within = CLOSED_BY.get(tag, (frozenset(), frozenset()))
            if ends and (depth := opened.first_after(ends, opened.last(within))) is not None:
                opened.pop_to(depth)
        if tag == "br":
            if open_block is not None:
                open_block.parts.append(" ")
            continue
        if tag in VOID_TAGS:
            continue
        above = opened.inner
        part = _page_part(tag, m["attrs"])
        # The header of an article holds its heading; only its other lines are no text.
        heading = tag in HEADINGS and above.tag == "header" and opened.last(("article", "main")) > 0
        excluded = (above.excluded and not heading) or part == _CERTAIN
        path = paths.setdefault((above.path, tag), len(paths) + 1) if tag in BLOCK_TAGS else above.path
        if tag in _RAW:
            at = _RAW_END[tag].search(page, at).end()
            continue
        elements.append(Element(tag, opened.stack[-1], path, excluded, part, above.in_link or tag == "a"))
        closed = m["attrs"].rstrip().endswith("/") and not _BARE_VALUE.search(m["attrs"])
        if not closed or tag in BLOCK_TAGS:
            opened.push(len(elements) - 1)
    for block in blocks:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        block.marks = len(_MARKS.findall(block.text))
    blocks = [b for b in blocks if b.text]
    exclude_named(elements, blocks)
    return elements, blocks


def exclude_named(elements: list[Element], blocks: list[Block]) -> None:
    """Excludes blocks in elements that are named like page parts, unless their text speaks against it."""
    # Per element: blocks, characters, marks, characters in links, and first-level headings.
    counts, chars, marks, links, headings = held = [[0] * len(elements) for _ in range(5)]
    for b in blocks:
        if not b.excluded:
            i = b.element
            counts[i] += 1
            chars[i] += len(b.text)
            marks[i] += b.marks
            links[i] += b.link_chars
            headings[i] += elements[i].tag == "h1"
    for sums in held:
        _add_to_parents(sums, elements)
    out = [False] * len(elements)
    for i, element in enumerate(elements):
        out[i] = i > 0 and out[element.parent]
        if element.named in (_DOUBTFUL, _NAMED):
            most = chars[i] >= MOST * chars[0] or (headings[i] and chars[i] >= MOST_WITH_HEADING * chars[0])
            prose = chars[i] >= PROSE_CHARS * counts[i] and marks[i] >= PROSE_MARKS * counts[i]
            prose = prose and element.named == _DOUBTFUL and links[i] <= PROSE_LINKS * chars[i]
            out[i] = out[i] or not (most or prose)
    for b in blocks:
        b.excluded = b.excluded or out[b.element]


def _add_to_parents(sums: list, elements: list[Element]) -> None:
    """Adds what each element holds to all elements around it; parents come before their children."""
    for i in range(len(elements) - 1, 0, -1):
        if sums[i]:
            sums[elements[i].parent] += sums[i]


def path_sums(blocks: list[Block]) -> dict[int, tuple[int, int, int, int]]:
    """Blocks, characters, punctuation marks and characters in links of each tag path."""
    sums: dict[int, tuple[int, int, int, int]] = {}
    for block in blocks:
        n, chars, marks, links = sums.get(block.path, (0, 0, 0, 0))
        sums[block.path] = (n + 1, chars + len(block.text), marks + block.marks, links + block.link_chars)
    return sums


def content_scores(blocks: list[Block], sums: dict[int, tuple[int, int, int, int]]) -> np.ndarray:
    """Fused and smoothed path ratios of the blocks."""
    ratio = {
        path: (chars / n) * (marks / n + 0.1) * max(0.0, 1 - links / chars) for path, (n, chars, marks, links) in sums.items()
    }
    raw = np.log1p(np.array([0.0 if b.excluded else ratio[b.path] for b in blocks]))
    smooth = SMOOTH[0] * raw
    for k, w in enumerate(SMOOTH[1:], 1):
        padded = np.pad(raw, k, mode="edge")
        smooth += w * (padded[2 * k :] + padded[: -2 * k])
    return smooth


def _menus(sums: dict[int, tuple[int, int, int, int]], declared: bool) -> set[int]:
    """Paths of menus.  In a declared article a list of links may be a list of sources, so more must speak for it."""
    if not declared:
        return {path for path, (_, chars, _, links) in sums.items() if links > LINK_SHARE * chars}
    return {
        path
        for path, (n, chars, marks, links) in sums.items()
        if n > 1 and links > MENU_LINK_SHARE * chars and chars < MENU_CHARS * n and marks < MENU_MARKS * n
    }


def _widened(best: int, elements: list[Element], blocks: list[Block], menus: set[int]) -> int:
    """The last parent of ``best`` up to which each adds its first-level heading, or neither page parts nor menus."""
    chain = [best]
    while chain[-1] > 0:
        chain.append(elements[chain[-1]].parent)
    # Of each element the place of its first ancestor in the chain, and whether a heading lies between.
    level, title = [-1] * len(elements), [False] * len(elements)
    for k, i in enumerate(chain):
        level[i] = k
    for i, element in enumerate(elements):
        if level[i] < 0:
            level[i] = level[element.parent]
            title[i] = element.tag == "h1" or title[element.parent]
    foreign = {level[b.element] for b in blocks if b.excluded or b.path in menus}
    titled = {level[b.element] for b in blocks if not b.excluded and b.path not in menus and title[b.element]}
    k = 0
    while k + 1 < len(chain) and (k + 1 in titled or k + 1 not in foreign):
        k += 1
    return chain[k]


def main_text(page: str) -> str:
    """Blocks of the article, each with single spaces, joined by an empty line."""
    elements, blocks = parse(page)
    usable = [b for b in blocks if not b.excluded]
    if not usable:
        return ""
    sums = path_sums(blocks)
    scores = content_scores(blocks, sums)
    scores = scores[[not b.excluded for b in blocks]]
    sizes = np.array([len(b.text) for b in usable], float)
    content = scores >= THRESHOLD * float((scores * sizes).sum() / sizes.sum())
    # Text of content nodes in each element.
    held = [0] * len(elements)
    for block, good in zip(usable, content.tolist()):
        if good:
            held[block.element] += len(block.text)
    _add_to_parents(held, elements)
    inner = frozenset(("p", "li", "td", "pre", "blockquote", *HEADINGS))

    def deepest(least: float) -> int:
        """The deepest element with so much of it, but no single paragraph or list of one."""
        return next((i for i in range(len(held) - 1, 0, -1) if held[i] >= least and elements[i].tag not in inner), 0)

    # A declared article around nearly all of it has the last word.
    best = deepest(COVER * held[0])
    while best > 0 and elements[best].tag not in ("article", "main"):
        best = elements[best].parent
    menus = _menus(sums, declared=best > 0)
    if best == 0:
        best = _widened(deepest(held[0]), elements, blocks, menus)
    inside = [i == best for i in range(len(elements))]
    for i in range(best + 1, len(elements)):
        inside[i] = inside[elements[i].parent]
    return "\n\n".join(b.text for b in usable if inside[b.element] and b.path not in menus)


@pandas_udf(T.StringType())
def main_text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p or "") for p in pages])


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text and n_chars, its code points.

    A null or empty page, and one without any article text, has an empty text.  Null ids and
    addresses stay, repeated rows are parsed each, an empty table gives no rows; other columns
    are not read.
    """
    found = pages.select("page_id", "url", main_text_of("html").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

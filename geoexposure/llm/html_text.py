"""Main text of web pages by composite text density.

A page becomes a tree of its elements, without those that never hold an article (scripts, menus, forms, what its class names an advert, comments and so
on). Each node counts its characters and tags, and how many of them are in links; its density is characters for each tag, less where links
make up much of it. The node whose children have the largest sum of densities is the heart of the article. The least density on its way
to the body is the threshold: the way is climbed while what else a parent holds is dense enough, or holds parts of the same kind, so an article of several sections stays whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.llm.shared import filled, slices

#: What a parent holds beside the part found so far must have this share of the threshold.
SHARE = 0.5

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never the article's.
NEVER = frozenset(
    "script style noscript template iframe object embed svg canvas audio video map form button input select textarea datalist nav footer aside dialog menu search head title noframes math".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or an id that tell what an element is for.
SIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr "
    "notice newsletter subscribe subscription signup login share sharing social comment comments reply replies disqus respond related recommended recommendations widget popup modal overlay pagination pager skip".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An end that is left out is looked for up to here only.
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}} | dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), {"table"})

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element of a page. ``parts``: its texts (string, whether in a link), blocks within it and None where a block ends, in page order."""

    __slots__ = ("chars", "counts", "density", "kind", "leaf", "link_chars", "link_tags", "parent", "parts", "side", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, side: bool = False, name: str = ""):
        self.tag, self.parent, self.side = tag, parent, side
        self.kind = (tag, name) if name or tag != "div" else None  # what parallel parts of an article share
        self.parts: list[tuple[str, bool] | Node | None] = []
        self.counts = self.leaf = True
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _by_its_name(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether class, id or role say that an element stands beside the article."""
    if tag in ("html", "body", "article", "main"):
        return tag == "article" and bool({"comment", "comments", "reply"} & _words(attrs))
    return attrs.get("role") in ROLES or bool(SIDE & _words(attrs))


def _words(attrs: dict[str, str | None]) -> set[str]:
    return {w.lower() for name in ("class", "id") for w in _NAME.findall(attrs.get(name) or "")}


class Page(HTMLParser):
    """Builds the tree of blocks. Inline elements form no nodes: their text is that of their block, links count for it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("body", None)
        self.links, self.skipped, self.held = 0, None, 0
        self.nodes, self.opened = [self.root], Counter()
        self.first: Node | None = None
        self.feed(html)
        self.close()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped:
            self.held += tag == self.skipped and tag not in VOID
            return
        named = dict(attrs)
        if tag in NEVER or "hidden" in named or _HIDDEN.search(named.get("style") or ""):
            if tag not in VOID:
                self.skipped, self.held = tag, 1
            return
        if tag == "br" or tag in VOID - {"hr"}:
            self.here.parts.append((" ", False))
            return
        if tag not in BLOCKS:
            if tag == "a":
                self.links += 1
                self.here.link_tags += 1
                self.here.tags += 1
            return
        if tag in ("html", "body"):
            return
        self._end_left_out(tag)
        if tag == "hr":
            self.here.parts.append(None)
            return
        node = Node(tag, self.here, _by_its_name(tag, named), named.get("class") or "")
        if tag in ("article", "main") and self.first is None and not node.side:
            self.first = node
        self.here.leaf = False
        self.here.parts.append(node)
        self.here = node
        self.opened[tag] += 1
        self.nodes.append(node)

    def _end_left_out(self, tag: str) -> None:
        """Close what a new block ends without saying so: a paragraph, or an item of the same list."""
        ends, walls = (_CLOSES[tag], _WALLS[tag]) if tag in _CLOSES else ({"p"}, BLOCKS - {"p"})
        node, found = self.here, None
        while node.parent is not None and node.tag not in walls:
            found = node if node.tag in ends else found
            node = node.parent
        if found is not None:
            self._leave(found)
        if tag in _CLOSES:
            node = self.here
            if node.tag == "p" and node.parent is not None:
                self._leave(node)

    def _leave(self, node: Node) -> None:
        while self.here is not node.parent:
            self.opened[self.here.tag] -= 1
            self.here = self.here.parent
        self.links = 0

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            self.held -= tag == self.skipped
            if self.held <= 0:
                self.skipped = None
                self.here.parts.append((" ", False))
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif self.opened[tag] > 0:
            node = self.here
            while node.tag != tag:
                node = node.parent
            self._leave(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: a slash ends no element that has an end

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.here.parts.append((data, self.links > 0))


def _beside(page: Page, by_name: bool) -> None:
    """Mark the nodes that don't count. Names don't decide about what holds the page's first article."""
    kept, node = set(), page.first
    while node is not None:
        kept.add(node)
        node = node.parent
    for n in page.nodes[1:]:
        own = (by_name and n.side) or (n.tag == "header" and not _within(n, ("article", "main")))
        n.counts = n.parent.counts and (n in kept or not own)


def _within(node: Node, tags: tuple[str, ...]) -> bool:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node is not None


def _measure(page: Page) -> None:
    """Characters, tags, links and densities of all nodes that count; ``total`` is the sum of the densities of a node's children."""
    left = [n for n in page.nodes if n.counts]
    for n in reversed(left):
        for part in n.parts:
            if isinstance(part, tuple):
                size = len("".join(part[0].split()))
                n.chars += size
                n.link_chars += size if part[1] else 0
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
            n.parent.tags += n.tags + 1
            n.parent.link_tags += n.link_tags
    linked = page.root.link_chars / max(1, page.root.chars)
    for n in left:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, linked)
    for n in left:
        if n.parent is not None:
            n.parent.total += n.density


def density(chars: int, tags: int, link_chars: int, link_tags: int, linked: float) -> float:
    """Composite text density of a node; ``linked`` is the share of the page's characters that are in links."""
    if not chars:
        return 0.0
    plain = chars / max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + linked * chars + math.e)
    if base <= 1 + 1e-9:
        return plain  # a page without links has nothing to adjust for
    return plain * max(0.0, math.log(chars / max(1, link_chars) * (max(1, tags) / max(1, link_tags)))) / math.log(base)


def _article(page: Page) -> Node:
    """The node whose subtree is the article."""
    linked = page.root.link_chars / max(1, page.root.chars)
    best = max((n for n in page.nodes if n.counts), key=lambda n: (n.density if n.leaf else n.total, n.chars))
    way, node = [], best
    while node is not None:
        way.append(node)
        node = node.parent
    outer = [n for n in way if n.tag in ("article", "main")]
    if outer:
        return outer[-1]
    threshold = min(n.density for n in way)
    for parent in way[1:]:
        chars, tags = parent.chars - best.chars, parent.tags - best.tags
        alike = best.kind and any(isinstance(n, Node) and n is not best and n.counts and n.kind == best.kind for n in parent.parts)
        if chars and not alike and density(chars, tags, parent.link_chars - best.link_chars, parent.link_tags - best.link_tags, linked) < SHARE * threshold:
            break
        best = parent
    return best


def _blocks(node: Node) -> list[str]:
    """The texts of the blocks of a subtree in page order."""
    out, run, stack = [], [], [iter(node.parts)]

    def end() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    while stack:
        part = next(stack[-1], stack)
        if part is stack:
            stack.pop()
            end()
        elif isinstance(part, tuple):
            run.append(part[0])
        else:
            end()
            if part is not None and part.counts:
                stack.append(iter(part.parts))
    return out


def main_text(html: str) -> str:
    """The main text of a page, its blocks joined by line ends; empty if there is none."""
    page = Page(html)
    for by_name in (True, False):  # names decide unless nothing is left
        _beside(page, by_name)
        if any(part[0].strip() for n in page.nodes if n.counts for part in n.parts if isinstance(part, tuple)):
            _measure(page)
            return "\n".join(_blocks(_article(page)))
    return ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page's html.

    A null or empty html, or one without any article, gives an empty text; text without tags is one block. Very long pages are read whole, and
    broken markup is closed as browsers do. Repeated rows stay, each with its text; null ids and urls are kept. An empty table gives an
    empty table; other columns, of whatever names, are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = pa.array([main_text(h) if h else "" for h in filled(part.column("html")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts, pc.utf8_length(texts).cast(pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")

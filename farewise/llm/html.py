"""HTML extraction: composite text density.

The page is read into a tree of its block elements.  For every node the
composite text density is its characters per tag, scaled down as its share of
link text grows; a node's density sum adds the densities of its children.  The
subtree with the largest sum is the content.  The least density on the way from
it up to the body is the threshold: all other subtrees whose density reaches it
belong to the content too.  Of an ``article`` that holds content the whole element
is taken.  Elements that are
no prose by their tag or role (menus, headers, footers, scripts) or hidden are
neither candidates nor text.  So are forms and elements with a class or id that
names a sidebar, notice, advert, comment or the like, unless the page keeps its
text in them (see ``settle_marks``); then density decides on them too.

Defined cases: null, empty or tagless input gives its plain text (empty for
null); an unfinished tag at the end is dropped; unclosed elements end where the
page does.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import pick

# Log bases below this count as this: pages without any link have base 1.
LEAST_BASE = 1.1

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split()
)
CLOSED_BY_SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
# What marks an element as no prose.
NO_PROSE_TAGS = frozenset(
    "head nav footer aside button select option input menu dialog object embed svg canvas audio video map".split()
) | RAW
NO_PROSE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
NO_PROSE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations widget pagination pager toolbar".split()
)
# A compound name counts only where its other words say nothing of their own ("share-buttons", not "has-share-buttons").
NEUTRAL_WORDS = frozenset(
    "area bar block box button buttons container icon icons inner item items left links list right section site slot "
    "top bottom unit wrap wrapper posts".split()
)
# Texts by others, which may well be longer than the article they stand by, and be articles themselves.
BY_OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply "
    "replies cookie cookies consent gdpr notice notices newsletter related recommended".split()
)
NEVER_BY_NAME = frozenset("html body article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*\Z",
    re.S,
)
_UNENDED = re.compile(r"<[!?]|</?[a-zA-Z][^<>]*\Z")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "prose", "chars", "link_chars", "tags", "link_tags", "own", "density", "sum", "marks",
                 "said")

    def __init__(self, tag: str, parent: Node | None, prose: bool, marks: frozenset[str] = frozenset()):
        self.tag, self.parent, self.prose, self.children, self.marks, self.said = tag, parent, prose, [], marks, 0
        self.chars = self.link_chars = self.tags = self.link_tags = self.own = 0
        self.density = self.sum = 0.0


def _is_prose(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NO_PROSE_TAGS or (tag == "header" and not in_article):
        return False
    if not attributes or tag in NEVER_BY_NAME:
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return False
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return False
        if name == "role" and value.lower() in NO_PROSE_ROLES:
            return False
    return True


def _marks(tag: str, attributes: str) -> frozenset[str]:
    """The words by which an element may be no prose: of its whole class and id names, and "form"."""
    found = {"form"} if tag == "form" else set()
    if attributes and tag not in NEVER_BY_NAME:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "role" and value.lower() == "form":
                found.add("form")
            if name in ("class", "id"):
                for token in value.split():
                    words = {w.lower() for w in _NAME_WORD.findall(token) if not w.isdigit()}
                    if words <= NO_PROSE_WORDS | NEUTRAL_WORDS:
                        found |= words & NO_PROSE_WORDS
    return frozenset(found)


def parse(html: str) -> tuple[Node, list[tuple[Node, str]], list[Node]]:
    """The root, the text blocks (node, text) in page order, and all nodes, parents first."""
    root = Node("#root", None, True)
    nodes, blocks, stack = [root], [], [root]  # stack: open elements; inline ones as (tag, block node)
    tags: list[str] = ["#root"]
    # by tag the depths at which it is open; the depths of block elements
    opened: dict[str, list[int]] = {}
    block_depths = [0]
    buffer: list[str] = []
    links = 0

    def flush():
        nonlocal buffer
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((stack[-1], text))
            buffer = []

    def close(depth: int):
        nonlocal links
        if block_depths[-1] >= depth:
            flush()
        for t in reversed(tags[depth:]):
            opened[t].pop()
            links -= t == "a"
        while block_depths[-1] >= depth:
            block_depths.pop()
        del tags[depth:], stack[depth:]

    def put(text: str):
        text = unescape(text)
        node = stack[-1]
        buffer.append(text)
        n = len("".join(text.split()))
        node.chars += n
        node.own += n
        if links:
            node.link_chars += n

    def deepest(some: tuple[str, ...]) -> int:
        return max((opened[t][-1] for t in some if opened.get(t)), default=0)

    def innermost(wanted: tuple[str, ...], stop: tuple[str, ...]) -> int:
        """Depth of the innermost open element of ``wanted``, 0 where one of ``stop`` is within it."""
        d = deepest(wanted)
        return d if d > deepest(stop) else 0

    at, end, last = 0, len(html), html.rfind(">")
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            put(html[at:])
            break
        if lt > last:
            # no tag ends any more: the rest is text, but for a comment or an unfinished tag at the end
            rest = _UNENDED.search(html, lt)
            put(html[at: rest.start() if rest else end])
            break
        m = _TOKEN.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            put(html[at: lt + 1])
            at = lt + 1
            continue
        if lt > at:
            put(html[at:lt])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            d = deepest((tag,))
            if d > 0 and not (tag in INLINE and block_depths[-1] > d):
                close(d)
            elif tag not in INLINE:
                flush()
            continue
        if tag in CLOSES_P and (d := innermost(("p",), ("table", "td", "th", "button", "object"))):
            close(d)
        if tag in CLOSED_BY_SAME and (d := innermost(CLOSED_BY_SAME[tag], SCOPE.get(tag, ()))):
            close(d)
        node = stack[-1]
        node.tags += 1
        if links or tag == "a":
            node.link_tags += 1
        if tag in VOID:
            if tag in INLINE:
                buffer.append(" " if tag in ("br", "wbr") else "")
            else:
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        in_article = bool(opened.get("article") or opened.get("main"))
        prose = node.prose and _is_prose(tag, m[3], in_article)
        marks = _marks(tag, m[3]) if prose else frozenset()
        if tag in INLINE and prose == node.prose and not marks:
            stack.append(node)
        else:
            flush()
            child = Node(tag, node, prose, marks)
            node.children.append(child)
            nodes.append(child)
            stack.append(child)
        opened.setdefault(tag, []).append(len(tags))
        if tag not in INLINE:
            block_depths.append(len(tags))
        tags.append(tag)
        links += tag == "a"
    flush()
    return root, blocks, nodes


def settle_marks(nodes: list[Node]) -> None:
    """Decides which marked elements are no prose, from the text outside of links that they hold.

    A mark says nothing where the elements with it hold over half of the text of the
    page (or of the article or main element they lie in), where all h1, article or main
    elements of the page lie in marked elements (one that holds any is prose), and where
    marks would leave no text.  Comments, adverts, notices and other texts by others
    stay out however long they are.  Comes before the counts of children are added to their parents."""
    if not any(n.marks for n in nodes):
        return
    for n in nodes:
        n.said = n.own - n.link_chars if n.prose else 0
    for n in reversed(nodes):  # children before parents
        if n.parent is not None:
            n.parent.said += n.said
    none: frozenset[str] = frozenset()
    # by node: nearest article or main; marks from there down to it; all marks down to it
    scope, words, under = {}, {}, {}
    held: dict[tuple[int, str], int] = {}
    for n in nodes:  # parents first
        up = id(n.parent)
        if n.parent is None or n.tag in ("article", "main"):
            scope[id(n)], words[id(n)] = n, none
        else:
            scope[id(n)], words[id(n)] = scope[up], words[up]
        above = under.get(up, none)
        under[id(n)] = above if n.marks <= above else above | n.marks
        if new := n.marks - words[id(n)]:
            words[id(n)] = words[id(n)] | new
            for w in new:
                key = (id(scope[id(n)]), w)
                held[key] = held.get(key, 0) + n.said
    anchors = [n for n in nodes if n.prose and n.said and n.tag in ("h1", "article", "main")]
    freed: set[tuple[int, str]] = set()
    for kind in ("h1", "article", "main"):
        some = [n for n in anchors if n.tag == kind]
        if all(under[id(n)] for n in some):
            for n in some:
                while n is not None and (id(n), kind) not in freed:
                    freed.add((id(n), kind))
                    n = n.parent
    def holds(n: Node) -> bool:
        """Whether a mark of ``n`` stands."""
        if (id(n), "h1") in freed or (id(n), "main") in freed:
            return False
        at = scope[id(n)]
        for w in n.marks:
            others = w in BY_OTHERS
            if (id(n), "article") in freed and not others:
                continue
            if others or 2 * held.get((id(at), w), 0) <= at.said:
                return True
        return False

    out = {id(n) for n in nodes if n.marks and holds(n)}
    prose = {}
    for n in nodes:
        prose[id(n)] = n.prose and id(n) not in out and (n.parent is None or prose[id(n.parent)])
    if any(prose[id(n)] and n.own > n.link_chars for n in nodes):
        for n in nodes:
            n.prose = prose[id(n)]


def composite_density(n: Node, body_ratio: float) -> float:
    """Characters per tag, times the log (to a base that grows with the link text) of
    characters per link character and tags per link tag; empty denominators count as 1."""
    if not n.chars:
        return 0.0
    base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + body_ratio * n.chars + math.e)
    ratio = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
    return n.chars / max(1, n.tags) * max(0.0, math.log(ratio) / math.log(max(base, LEAST_BASE)))


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by line breaks."""
    root, blocks, nodes = parse(html or "")
    settle_marks(nodes)
    for n in reversed(nodes):  # children before parents
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.link_chars += n.link_chars
            p.tags += n.tags
            p.link_tags += n.link_tags
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for n in nodes:
        n.density = composite_density(n, ratio)
    candidates = [n for n in nodes if n.prose and n.tag != "html"]
    for n in candidates:
        n.sum = sum(c.density for c in n.children if c.prose) + (n.density if n.own else 0.0)
    best = max(candidates, key=lambda n: n.sum)
    path, n = [], best
    while n is not None:
        path.append(n)
        n = n.parent if n is not body else None
    on_path = {id(n) for n in path}
    threshold = min(n.density for n in path)
    chosen = {id(best)}
    for n in candidates:
        if id(n) not in on_path and n.density >= threshold:
            chosen.add(id(n))
    holding: set[int] = set()
    for n in reversed(nodes):  # children before parents
        if id(n) in chosen or id(n) in holding:
            holding.add(id(n.parent))
            if n.tag == "article":
                chosen.add(id(n))
    inside: set[int] = set()
    for n in nodes:  # parents first
        if id(n) in chosen or (n.parent is not None and id(n.parent) in inside):
            inside.add(id(n))
    return "\n".join(text for node, text in blocks if node.prose and id(node) in inside)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = pick(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    )
    return slim.mapInArrow(per_batch, "page_id long, url string, text string, n_chars long")

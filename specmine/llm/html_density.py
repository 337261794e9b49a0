"""Main text of web pages by composite text density.

Each page becomes a tree of block elements. A node's density is its characters for each tag,
adjusted for links: links make text count less, the more so the more of a page's text is
links. The sum of its children's densities picks the subtree of most content. The least density
on the path from there to the body is the threshold at which text elsewhere counts as content:
from the densest subtree the choice goes up as long as what its parent adds is mostly such
text. Last, it takes in a headline right before it, and an enclosing article or main element of
whose text it has the greater part. Nothing is dropped from the chosen subtree but furniture.

Furniture are elements that never hold the article, by tag, or if hidden. Words of class, id or role, whole or as
compounds of such and neutral words ("ad-box"), are a hint which structure and place confirm: words of adverts and of sections of
reader comments count anywhere; a lone "comment" inside an article only if it has a sibling like it; words of
menus, sidebars, notices and the like outside article and main elements, inside them only on elements that are
mostly links, or as part of a compound ("related-articles") on elements of at most a quarter of the page's text.
Elements that hold an article or main element, or more than half of the page's text that isn't links
(adverts and comments: all of it), are no furniture.

Defined results: null, empty or markup-only pages give an empty text; unclosed, stray and
truncated tags are read as a browser would close them; repeated rows give equal texts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.llm.common import pieces

# Element names and the class, id and role words of page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
INLINE |= {"math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "mstyle", "mpadded", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "menclose"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "svg", "object", "embed", "head", "fieldset", "audio", "video", "canvas", "annotation", "annotation-xml"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "comment", "comments", "disqus", "respond", "reply", "login", "signup", "search", "pagination", "pager", "toolbar", "complementary", "contentinfo", "alert",
}
CERTAIN = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "comments", "disqus"}
# parts of compounds that say nothing themselves; a compound counts if it has no other words
NEUTRAL = {"area", "article", "articles", "bar", "block", "bottom", "box", "button", "container", "feed", "form", "group", "inline", "item", "items", "left", "link", "links", "list", "more", "panel", "post", "posts", "reader", "readers", "right", "section", "side", "slot", "thread", "top", "unit", "user", "users", "wrapper"}
HEADER = {"header", "banner"}
HOLDERS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
# what a start tag closes if it is open, up to a boundary
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
P_BOUNDS = {"table", "td", "th", "button", "caption", "object"}
P_CLOSERS = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "furniture", "suspect", "plain", "linked", "holds")

    def __init__(self, tag: str, parent: Node | None, furniture: bool):
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.suspect, self.holds = 0, False
        self.plain = self.linked = 0


def is_furniture(tag: str, attributes: str, within_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not within_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *value in ATTRIBUTE.findall(attributes):
        name, text = name.lower(), (value[0] or value[1] or value[2]).lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", text):
            return True
    return False


def suspicion(tag: str, attributes: str, within_article: bool) -> int:
    """How class, id or role hint at furniture: 2 wherever it stands, 1 outside articles, 5 if it is a small part of the
    page, 4 if it has a sibling like it, 3 if it is mostly links."""
    most = 0 if tag != "menu" else 3 if within_article else 1
    if not attributes:
        return most
    for name, *value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            words = {*(value[0] or value[1] or value[2]).lower().split()}
            parts = [[x for x in re.split("[-_]+", w) if x] for w in words]
            parts = [p for p in parts if all(x in WORDS or x in CERTAIN or x in NEUTRAL or x.isdigit() for x in p)]
            if any(x in CERTAIN for p in parts for x in p) or any(len(p) > 1 and "comment" in p for p in parts):
                return 2
            if "comment" in words:
                most = 4 if within_article else 2
            elif tag not in HOLDERS and any(len(p) > 1 and any(x in WORDS for x in p) for p in parts):
                most = most or (5 if within_article else 1)
            elif tag not in HOLDERS and (words & WORDS or words & HEADER):
                most = most or (3 if within_article else 1)
    return most


def without_suspects(nodes: list[Node]) -> list[Node]:
    """The nodes without the suspects that hold no article or main element and, of the page's text
    that isn't links, at most half (adverts and comments: not all); they leave their parents too."""
    if not any(x.suspect for x in nodes):
        return nodes
    for node in nodes:
        node.plain, node.linked = node.chars - node.link_chars, node.link_chars
    for node in reversed(nodes):
        if (p := node.parent) is not None:
            p.plain += node.plain
            p.linked += node.linked
            p.holds |= node.holds or node.tag in HOLDERS and not node.suspect
    out, touched = [], {}
    alike = Counter(id(x.parent) for x in nodes if x.suspect == 4)
    for node in nodes:  # parents come first
        if node.suspect == 4:
            node.suspect = 2 if alike[id(node.parent)] > 1 else 0
        elif node.suspect == 5:
            node.suspect = 1 if 4 * node.plain <= nodes[0].plain else 3
        p = node.parent
        if p is not None and p.furniture:
            node.furniture = True
        elif node.suspect == 2 and not node.holds and node.plain < nodes[0].plain:
            node.furniture = True
            touched[id(p)] = p
        elif node.suspect in (1, 3) and not node.holds and 2 * node.plain <= nodes[0].plain and (node.suspect == 1 or node.linked >= node.plain):
            node.furniture = True
            touched[id(p)] = p
        else:
            out.append(node)
    for p in touched.values():
        p.children = [x for x in p.children if not x.furniture]
        p.parts = [x for x in p.parts if isinstance(x, str) or not x.furniture]
    return out


def parse(page: str) -> list[Node]:
    """The nodes in page order, the root first; furniture is left out. Time is linear in the page:
    how many elements of a name are open, and the last open p and its bounds, are kept at hand."""
    root = Node("html", None, False)
    nodes, stack = [root], [root]
    links, inside = 0, 0  # open a elements; open article and main elements
    count: Counter[str] = Counter()
    marks: list[int] = []  # places of open p elements and of what bounds them
    muted: list[str] = []  # an open inline advert or hidden element, and those of its name inside
    depth = at = 0

    def put(text: str) -> None:
        node = stack[-1]
        if not node.furniture and text and not muted:
            text = html.unescape(text) if "&" in text else text
            node.parts.append(text)
            n = len(SPACE.sub(" ", text).strip())
            node.chars += n
            node.link_chars += n * bool(links)

    def close(to: int) -> None:
        nonlocal inside
        while len(stack) > to:
            tag = stack.pop().tag
            inside -= tag in HOLDERS
            count[tag] -= 1
        while marks and marks[-1] >= to:
            marks.pop()
        if len(stack) <= depth:
            muted.clear()

    while True:
        found = TOKEN.search(page, at)
        put(page[at : found.start()] if found else page[at:])
        if not found:
            return without_suspects(nodes)
        at = found.end()
        slash, tag, attributes = found[1] if found[2] else found[4], found[2] or found[5], found[3] or found[6] or ""
        if not tag:
            continue
        tag = tag.lower()
        top = stack[-1]
        if slash:
            if tag == "a":
                links = max(0, links - 1)
            if muted and muted[-1] == tag:
                muted.pop()
            if tag in INLINE:
                pass
            elif tag == "br":
                put(" ")
            elif tag not in ("html", "body") and count[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        links = 0 if tag in P_CLOSERS else links
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in INLINE or tag in VOID:
            if not top.furniture:
                top.tags += 1
                if tag == "a":
                    top.link_tags += 1
            if tag == "a":
                links = 1  # links don't nest
            elif tag in ("br", "hr", "img"):
                put(" ")
            if tag in INLINE and (muted and muted[-1] == tag or not muted and attributes and (is_furniture(tag, attributes, True) or suspicion(tag, attributes, True) == 2)):
                depth = depth if muted else len(stack) - 1
                muted.append(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in P_CLOSERS and marks and stack[marks[-1]].tag == "p":
            close(marks[-1])
            links = 0
        if tag in CLOSES and any(count[x] for x in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in BOUNDS[tag]:
                    break
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
        if stack[-1].tag == "head" and tag not in ("head", "base", "link"):
            close(len(stack) - 1)
        top = stack[-1]
        node = Node(tag, top, top.furniture or bool(muted) or is_furniture(tag, attributes, inside > 0))
        if not node.furniture:
            node.suspect = suspicion(tag, attributes, inside > 0)
            top.children.append(node)
            top.parts.append(node)
            nodes.append(node)
        if tag == "p" or tag in P_BOUNDS:
            marks.append(len(stack))
        stack.append(node)
        count[tag] += 1
        inside += tag in HOLDERS


def densities(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags + 1
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / lc * t / lt)) / max(0.1, math.log(base))  # without links the base is 1
    for node in nodes:
        node.total = sum(x.density for x in node.children)


def content(nodes: list[Node]) -> Node | None:
    """The node whose text is the page's main text."""
    densities(nodes)
    body = nodes[0]
    if not body.chars:
        return None
    best = body
    for node in nodes:  # of equal sums down a line, the innermost
        if node.total > best.total or node.total == best.total and node.parent is best:
            best = node
    if not best.total:
        return body
    threshold, up = best.density, best
    while up.parent is not None:
        threshold, up = min(threshold, up.density), up.parent
    # characters of each subtree in leaves that are dense enough
    for node in nodes:
        node.plain = node.chars if node.density >= threshold and not node.children else 0
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.plain += node.plain
    up = chosen = best
    while (up := up.parent) is not None:
        if up.plain > chosen.plain and 2 * (up.plain - chosen.plain) >= up.chars - chosen.chars:
            chosen = up
    if chosen.parent is not None and follows_headline(chosen):
        chosen = chosen.parent
    up = chosen
    while up is not None and up.tag not in HOLDERS:
        up = up.parent
    return up if up is not None and 2 * chosen.chars > up.chars else chosen


def follows_headline(node: Node) -> bool:
    """Whether a headline stands right before a node in its parent, and nothing else but it."""
    parts = [x for x in node.parent.parts if not isinstance(x, str) or x.strip()]
    before = parts[: parts.index(node)]
    return parts[-1] is node and any(not isinstance(x, str) and x.tag in ("h1", "h2") for x in before) and all(not isinstance(x, str) and x.tag in HEADINGS for x in before)


def text_of(node: Node | None) -> str:
    """Text of a subtree: white space becomes single spaces, blocks are joined by one."""
    out: list[str] = []
    todo: list[str | Node | None] = [node] if node is not None else []
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            out.append(" ")
            todo.append(" ")
            todo.extend(reversed(x.parts))
        elif x:
            out.append(x)
    return SPACE.sub(" ", "".join(out)).strip()


def main_text(page: str | None) -> str:
    return text_of(content(parse(page))) if page else ""


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Every row of ``pages`` without ``html_col``, with the main text added."""
    rest = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = pages.select(*[F.col(f"`{c}`") for c in rest], F.lit("").cast("string").alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, html_col):
                texts = [main_text(x) for x in batch.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, out_col])

    return pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html_col}`").cast("string").alias(html_col)).mapInArrow(run, schema)

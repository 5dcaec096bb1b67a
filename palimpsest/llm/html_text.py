"""Main text of web pages by composite text density (Sun, Song and Liao, SIGIR 2011).

Each node of the page's tree gets a composite density: its characters for each tag, adjusted
by how many of the characters and tags are links'. A node's density sum adds the densities of
its children. Densities cover the whole body, menus and all, as that noise sets the threshold.

The node with the largest sum that lies in no known boilerplate is the target; where that is a
paragraph or the like, the container around it. The least density on the path from it to the
body is the threshold. The target's subtree is main text. So are, beside each node of that
path, blocks that reach the threshold and are not mostly links, what stands between two such,
headings before the first, and (below the body) plain text blocks next to them.

Boilerplate is known by element (nav, footer, aside, form, ...), role, or a whole class or id
out of ``NAMES``; a name that only contains such a word is none, nor is the name of a wrapper
around an article or main element (but for comments, which may be articles). It is no target
and is taken out of the chosen subtrees.

Parsing and selection take time in proportion to the page, however deep or broken it is.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import strings

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; it is skipped unparsed.
_RAW = frozenset("script style textarea title noscript iframe template noembed noframes svg canvas object audio video".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option optgroup legend".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks of plain text, which stand beside each other in a container.
_PLAIN = _HEADINGS | frozenset("p ul ol dl table pre blockquote figure".split())
_CONTAINERS = frozenset("html article main section div td center details".split())
#: An opening tag of these ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag closes, and the elements that keep it from looking further out.
_SAME = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}
_P_SCOPE = ("td", "th", "table", "button")
_DROP = frozenset("nav footer aside form button select input dialog menu datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole classes and ids of menus, headers, footers, sidebars, notices, adverts and reader comments.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising ad-container ad-slot adbox adslot adsbygoogle banner sponsor sponsored promo promotion
    comment comments comment-list commentlist comment-section comments-section comments-area disqus disqus_thread replies respond
    sidebar side-bar left-sidebar right-sidebar widget widgets menu main-menu nav navbar navigation main-nav site-nav breadcrumb breadcrumbs
    header site-header page-header masthead topbar top-bar footer site-footer page-footer bottombar
    cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent consent gdpr notice notification alert popup modal overlay
    newsletter newsletter-signup subscribe signup login share sharing share-buttons social social-links social-share
    related related-posts related-articles recommended pagination pager toolbar search search-box search-form skip-link toc""".split()
)
_COMMENTS = frozenset(n for n in NAMES if n.startswith(("comment", "disqus", "repl", "respond")))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_GAP = re.compile(r"[\s/]*")
_HEAD_END = re.compile(r"</head[\s/>]|<body[\s/>]", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in _RAW | {"xmp"}}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.density = self.total = 0.0
        #: Whether the node is, or lies in, known boilerplate.
        self.dropped = False


class _Open:
    """The open elements, with the places of each tag in the stack."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        """The place of the innermost open element of the tag, 0 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def cut(self, place: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()

    def close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Closes the outermost of ``tags`` inside the innermost of ``scope``."""
        wall = max(map(self.last, scope))
        found = [p[bisect_right(p, wall)] for t in tags if (p := self.places.get(t)) and p[-1] > wall]
        if found:
            self.cut(min(found))


def _attributes(page: str, i: int) -> tuple[dict[str, str], int]:
    """Attributes from i on, and the place after the tag. A quote that is never closed is no
    quote; it is the page's last of its kind, so that is found out once."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        i = _GAP.match(page, i).end()
        if i >= n:
            return found, n
        if page[i] == ">":
            return found, i + 1
        m = _ATTR.match(page, i)
        if m is None:
            i += 1
            continue
        i = m.end()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)


def parse(page: str) -> Node:
    """A tree of the page's body, tolerant of unclosed, stray and misplaced tags."""
    root = Node("html", {}, None)
    opened = _Open(root)
    i, n, headed = 0, len(page), False

    def text(s: str) -> None:
        if s:
            opened.stack[-1].children.append(html.unescape(s) if "&" in s else s)

    while i < n:
        at = page.find("<", i)
        if at < 0:
            text(page[i:])
            break
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?") or (follows == "/" and not page[at + 2 : at + 3].isalpha()):
            text(page[i:at])
            comment = page.startswith("<!--", at)
            end = page.find("-->", at + 4) if comment else page.find(">", at + 1)
            if comment and page.startswith(("<!-->", "<!--->"), at):
                end = page.find(">", at) - 2
            i = n if end < 0 else end + (3 if comment else 1)
            continue
        closing = follows == "/"
        m = _NAME.match(page, at + 1 + closing)
        if m is None:  # a lone angle bracket is text
            text(page[i : at + 1])
            i = at + 1
            continue
        text(page[i:at])
        tag = m[0].lower()
        attrs, i = _attributes(page, m.end())
        if closing:
            place = opened.last(tag)
            # the end tag of an inline element does not close a block around it
            if place and (tag in _BLOCK or place > opened.blocks[-1]):
                opened.cut(place)
            continue
        if tag == "head" and not headed:
            headed = True
            end = _HEAD_END.search(page, i)
            i = end.start() if end else i
        if tag in ("html", "body", "head"):
            continue
        if tag in _ENDS_P:
            opened.close(("p",), _P_SCOPE)
        if tag in _SAME:
            opened.close(*_SAME[tag])
        if tag in _HEADINGS and opened.stack[-1].tag in _HEADINGS - {"hgroup"}:
            opened.cut(len(opened.stack) - 1)
        node = Node(tag, attrs, opened.stack[-1])
        node.parent.children.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, i)
            if tag == "xmp":
                node.children.append(page[i : end.start() if end else n])
            i = end.end() if end else n
            continue
        opened.push(node)
    return root


def boilerplate(node: Node, inside: bool, wraps: bool) -> bool:
    """Whether a node by itself is known not to be main text; ``inside``: within an article or
    main element, whose header is its own; ``wraps``: around such an element."""
    tag, attrs = node.tag, node.attrs
    if tag in _DROP or (tag == "header" and not inside):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _ROLES or _HIDDEN.search(attrs.get("style", "")):
        return True
    if tag in ("main", "html") or tag in _HEADINGS:  # a headline may be called a header
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    return not (_COMMENTS if wraps else NAMES).isdisjoint(names)


def _order(root: Node) -> list[Node]:
    """All nodes, each before its children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def _mark(nodes: list[Node]) -> None:
    """``dropped`` of each node; nodes come before their children."""
    inside, around = set(), set()
    for node in reversed(nodes):
        if node.parent is not None and (node.tag in ("article", "main") or id(node) in around):
            around.add(id(node.parent))
    for node in nodes[1:]:
        up = node.parent
        if id(up) in inside or up.tag in ("article", "main"):
            inside.add(id(node))
        node.dropped = up.dropped or boilerplate(node, id(node) in inside, id(node) in around)


def _chars(text: str) -> int:
    return len(_SPACE.sub(" ", text).strip())


def _densities(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += _chars(c)
            else:
                chars, tags, link_chars, link_tags = chars + c.chars, tags + c.tags + 1, link_chars + c.link_chars, link_tags + c.link_tags
        node.chars, node.tags = chars, tags
        node.link_chars, node.link_tags = (chars, link_tags + 1) if node.tag == "a" else (link_chars, link_tags)
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        node.total = sum(c.density for c in node.children if not isinstance(c, str))


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite density; ``share`` is that of the body's characters which are links'."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / t * max(0.0, math.log(max(1.0, chars / lc * t / lt)) / base)


def _target(nodes: list[Node]) -> Node:
    """The container of the largest density sum; a page of one block has no better than its root."""
    best = max((x for x in nodes if not x.dropped), key=lambda x: x.total)
    if best.total <= 0:
        return nodes[0]
    while best.tag not in _CONTAINERS:
        best = best.parent
    return best


def content(root: Node) -> list[Node | str]:
    """The subtrees and bare texts that are the main text, in page order."""
    nodes = _order(root)
    _mark(nodes)
    _densities(nodes)
    target = _target(nodes)
    threshold, node = target.density, target
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    share = root.link_chars / root.chars if root.chars else 0.0

    def usable(c: Node | str) -> bool:
        return isinstance(c, str) or not (c.dropped or c.link_chars * 2 > c.chars)

    def dense(c: Node | str) -> bool:
        return usable(c) and ((density(_chars(c), 0, 0, 0, share) if isinstance(c, str) else c.density) >= threshold > 0)

    before: list[list] = []
    after: list[list] = []
    on, up = target, target.parent
    while up is not None:
        kids = up.children
        at = next(i for i, c in enumerate(kids) if c is on)
        first = next((i for i, c in enumerate(kids[:at]) if dense(c)), at)
        last = next((i for i in range(len(kids) - 1, at, -1) if dense(kids[i])), at)
        i, found = first - 1, first
        while i >= 0 and usable(kids[i]):  # headings before the first
            if not isinstance(kids[i], str) and kids[i].tag in _HEADINGS:
                found = i
            i -= 1
        first = found
        if up.parent is not None:  # plain text next to it
            while first > 0 and _plain(kids[first - 1]) and usable(kids[first - 1]):
                first -= 1
            while last + 1 < len(kids) and _plain(kids[last + 1]) and usable(kids[last + 1]):
                last += 1
        before.append([c for c in kids[first:at] if usable(c)])
        after.append([c for c in kids[at + 1 : last + 1] if usable(c)])
        on, up = up, up.parent
    return [*(c for cs in reversed(before) for c in cs), target, *(c for cs in after for c in cs)]


def _plain(c: Node | str) -> bool:
    return isinstance(c, str) or c.tag in _PLAIN or c.tag not in _BLOCK


def text_of(tops: list[Node | str]) -> str:
    """The blocks' texts, one to a line; white space in a block is one space. Boilerplate
    inside is left out."""
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if text := _SPACE.sub(" ", "".join(parts)).strip():
            blocks.append(text)
        parts.clear()

    todo: list = list(reversed(tops))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            parts.append(x)
        else:
            if x.tag == "br":
                parts.append(" ")
            if x.tag in _BLOCK:
                end()
                todo.append(None)
            if not x.dropped:
                todo += reversed(x.children)
    end()
    return "\n".join(blocks)


def main_text(page: str) -> str:
    return text_of(content(parse(page)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with columns text and n_chars (its code points), which replace any so named.

    A null or empty page, and one without main text, gives '' and 0. Rows and other columns
    pass unchanged; repeated rows each come back.
    """

    @F.arrow_udf("string")
    def main_texts(page: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in strings(page)], pa.string())

    made = pages.withColumn("text", main_texts(F.col(html_col).cast("string")))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")

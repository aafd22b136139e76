"""Main text of web pages by composite text density.

A page becomes a light DOM: one forward scan over its tags that closes what HTML closes by itself (paragraphs, list items,
table cells), drops scripts, styles, comments and the like, and treats the rest of the markup by nesting, in time that
grows with the page's length whatever its markup. For every node the
density is its characters per tag, adjusted for links (text inside links counts against it, by its share of the node's
and of the body's text). A node's density sum is the sum of its children's densities, without those that surround an
article by tag, class or role. The main subtree is the node of the largest density sum, narrowed to the child that holds
most of its text and has blocks of its own, and widened to an ``article`` or ``main`` around it. The threshold is the
smallest density on the path from there to the body. Beside that path stay paragraphs and texts that reach the threshold
and are as long as the main subtree's mean block, sections built like the main one (a heading over plain paragraphs), all
that lies between two of these, and headings before them; behind an ``article`` or ``main`` nothing does. Lists of links
below the threshold go, except those under a heading of an article. The blocks are printed in page order, without
navigation, headers, footers, sidebars, notices, adverts, forms and comments. Names in class, id or role mark surroundings
only where all of their words do, and neither they nor a form where they hold the page's article or most of its text
outside of links (readers' comments: nearly all).

Defined results: null, empty or tagless html gives an empty text or its plain text; unclosed and stray tags never fail;
repeated rows give a row each; an empty table gives an empty result; further columns are ignored.
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

PAGES_AT_ONCE = 64

#: A comment, another declaration, or a tag. A tag ends at its ``>``, or before a ``<`` outside of quotes. Every position
#: is passed a bounded number of times: runs never give back, and a quote is looked for up to the next one only.
_MARK = re.compile(
    r"<(?:!--(?:.*?-->|.*)|[!?][^>]*+>?"
    r"|(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"<]*+\"|\"[^\"]*+\"(?=[\s/>])|'[^'<]*+'|'[^']*+'(?=[\s/>])|[\"'])*+)>?)",
    re.S,
)
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPACES = re.compile(r"\s+")
#: Headings of what readers wrote.
_READERS = re.compile(r"\b(?:repl(?:y|ies)|comments?|responses?|discussion)\b", re.I)
#: Headings of lists that lead elsewhere.
_AROUND_TITLE = re.compile(r"\b(?:related|recommended|share|more|popular|latest|trending|tags|menu|navigation)\b", re.I)
#: Numbers and versions in names say nothing.
_NUMBERS = re.compile(r"(?:\bv|(?<=[-_])v)?\d+", re.I)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

#: Elements nested deeper than this are taken as if they lay beside each other.
DEPTH = 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style noscript template svg iframe object canvas textarea select title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of an article.
AROUND = frozenset("nav aside footer form button dialog menu head".split())
#: Words in class, id or role that mark what surrounds an article: where each word of a name is one of them or says no
#: more than that something is there (PLAIN_NAMES). So ``site-footer`` does, ``with-sidebar`` or ``related-work`` don't.
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs"
    " comment comments respond disqus cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup"
    " footer header masthead menu nav navbar navigation sidebar widget widgets related recommended share sharing social"
    " toolbar pagination pager search login complementary contentinfo alert".split()
)
PLAIN_NAMES = frozenset(
    "a area bar bars block blocks bottom box boxes btn button buttons container div entry form global icons inner item items"
    " layer left links list lists main middle outer overlay page panel post posts primary reader readers right row secondary"
    " section sections site slot space strip text thread title top unit user users wrap wrapper zone".split()
)
#: Of these, what marks the readers' part of a page even where it is the longer one.
COMMENT_WORDS = frozenset("comment comments respond disqus".split())
#: Of these, what names the head of an article too, inside of one.
HEAD_WORDS = frozenset("header banner".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: So many links make a list.
LIST_LINKS = 3
#: Start tags that end an open element of the second kind, up to the nearest element of the third.
ENDS_P = BLOCKS - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
IMPLIED = {
    **{t: (frozenset({"p"}), frozenset("div article section main body td th li blockquote aside header footer form".split())) for t in ENDS_P},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
}


class Node:
    __slots__ = ("around", "chars", "density", "depth", "doubtful", "inside", "items", "link_chars", "links", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        #: Whether it lies in an article or is one.
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.around, self.doubtful = _is_around(tag, attributes, self.inside)
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.sum = 0.0


def _is_around(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether a node surrounds an article; whether that is in doubt, by how much of the page it holds."""
    if attributes and _HIDDEN.search(attributes):
        return True, False
    if tag in AROUND or (tag == "header" and not inside):
        return True, tag == "form"
    if not attributes or tag in ("body", "html", "article", "main"):
        return False, False
    listed = AROUND_WORDS - HEAD_WORDS if inside else AROUND_WORDS
    around = False
    for m in _CLASS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {x.lower() for x in _NAME_PARTS.findall(_NUMBERS.sub("", name))}
            if words & listed and words <= listed | PLAIN_NAMES:
                if words & COMMENT_WORDS:
                    return True, False
                around = True
    return around, True


def parse(page: str) -> Node:
    """The body of a page, in one pass."""
    root = Node("body", None)
    node, at = root, 0
    opened: Counter[str] = Counter()
    beyond: Counter[str] = Counter()  # of those too deep
    endless: set[str] = set()

    def close(to: Node) -> Node:
        x = node
        while x is not to:
            opened[x.tag] -= 1
            x = x.parent
        return to

    while m := _MARK.search(page, at):
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if beyond[tag]:
                beyond[tag] -= 1
                node.items.append(Node("div", node) if tag in BLOCKS else "")
                continue
            if tag in VOID or not opened[tag]:
                continue
            up = node
            while up.tag != tag:
                if up.tag in BLOCKS and tag not in BLOCKS:  # an inline end tag does not end blocks
                    up = None
                    break
                up = up.parent
            if up is not None:
                node = close(up.parent)
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            if end:
                at = page.find(">", end.end()) + 1 or len(page)
            else:
                endless.add(tag)  # nor is there one further on
                at = len(page) if tag in ("script", "style") else at
            if tag not in ("script", "style"):
                node.items.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            node.tags += 1
            node.items.append("\n" if tag in ("br", "hr") else " " if tag in ("img", "input") else "")
            continue
        if (rule := IMPLIED.get(tag)) and any(opened[x] for x in rule[0]):
            up = node
            while up is not root and up.tag not in rule[1]:
                if up.tag in rule[0]:
                    node = close(up.parent)
                    break
                up = up.parent
        if m[3].endswith("/") and tag not in BLOCKS:
            node.tags += 1
            continue
        if node.depth >= DEPTH:
            beyond[tag] += 1
            node.items.append(Node("div" if tag in BLOCKS else tag, node))  # the border alone
            continue
        child = Node(tag, node, m[3])
        opened[tag] += 1
        node.items.append(child)
        node = child
    if at < len(page):
        node.items.append(page[at:])
    return root


def measure(root: Node) -> None:
    """Characters, tags, link characters and links of every subtree, then densities and their sums."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        order.append((node, in_link))
        stack += [(x, in_link or x.tag == "a") for x in node.items if not isinstance(x, str)]
    for node, in_link in reversed(order):  # children first
        for x in node.items:
            if isinstance(x, str):
                n = len(" ".join(x.split()))
                node.chars += n
                if in_link:
                    node.link_chars += n
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.links += x.links + (x.tag == "a")
    body_share = root.link_chars / max(root.chars, 1)
    for node, _ in order:
        node.density = _density(node.chars, node.tags, node.link_chars, node.links, body_share)
    _clear_holders(root, [node for node, _ in order])
    for node, _ in order:
        node.sum = sum(x.density for x in node.items if not isinstance(x, str) and not x.around)


def _density(c: int, t: int, lc: int, lt: int, body_share: float) -> float:
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)
    inner = c / max(lc, 1) * t / lt
    return c / t * (math.log(inner) / math.log(base) if inner > 1 and base > 1 else 0.0)


def _plain(node: Node) -> int:
    """Characters outside of links."""
    return node.chars - node.link_chars


def _clear_holders(root: Node, nodes: list[Node]) -> None:
    """Nodes that hold the article, or most of the page's text, surround nothing, whatever their class says."""
    apart = set()  # in what is marked beyond doubt, as the readers' comments
    for x in nodes:  # parents first
        if (x.around and not x.doubtful) or x.parent in apart:
            apart.add(x)
    articles = [x for x in nodes if x.tag in ("article", "main") and x not in apart]
    up = max(articles, key=_plain, default=None)
    while up is not None:
        if up.doubtful:
            up.around = False
        up = up.parent
    for x in nodes:
        if x.around and x.doubtful and 2 * _plain(x) > _plain(root):
            x.around = False
        elif x.around and x.tag not in AROUND and 10 * _plain(x) > 9 * _plain(root):
            x.around = False


def main_subtree(root: Node) -> Node:
    """The page's tree, where all but the article is marked as around it."""
    measure(root)
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [x for x in node.items if not isinstance(x, str) and not x.around]
    found = max(nodes, key=lambda x: x.sum)  # the first in page order of equals
    while inner := _narrower(found):
        found = inner
    path = [found]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for tag in ("article", "main"):  # the outermost article, else the outermost main
        if at := [i for i, x in enumerate(path) if x.tag == tag]:
            found, path = path[at[-1]], path[at[-1] :]
            break
    threshold = min(x.density for x in path)
    named = found.tag in ("article", "main")
    if 2 * found.link_chars <= found.chars:  # a page of links is all lists
        _drop_lists(found, threshold, named)
    size = _plain(found) / max(sum(x.tag in BLOCKS and x.chars > 0 for x in _inside(found)), 1)
    body_share = root.link_chars / max(root.chars, 1)
    for child, up in zip(path, path[1:], strict=False):
        _beside(up, child, named, threshold, size, body_share)
    return root


def _drop_lists(found: Node, threshold: float, named: bool) -> None:
    """Marks lists of links in the main subtree; in an element that is ``named`` an article those under a heading, and
    paragraphs, are its own."""
    stack = [found]
    while stack:
        x = stack.pop()
        before = None
        for y in x.items:
            if isinstance(y, str) or y.around:
                continue
            if _is_list(y, threshold):
                titled = before is not None and before.tag in HEADINGS and not _AROUND_TITLE.search("".join(blocks(before)))
                if not (named and (titled or y.tag in PARAGRAPHS)):
                    y.around = True
            else:
                stack.append(y)
            before = y if y.chars else before


def _beside(up: Node, child: Node, named: bool, threshold: float, size: float, body_share: float) -> None:
    """Marks what is around the article among the nodes beside ``child``, which holds it. What stays by itself is dense text
    or a section; what lies between two of these stays with them, and so does a heading that one of them follows. Behind
    an element that is ``named`` an article nothing is."""
    middle = next(i for i, x in enumerate(up.items) if x is child)

    def kept(i: int, x: Node | str) -> bool:
        if x is child:
            return True
        if named and i > middle and (isinstance(x, str) or x.tag not in ("article", "main")):
            return False
        if isinstance(x, str):
            n = len(" ".join(x.split()))
            return n >= max(size, 1) and _density(n, 0, 0, 0, body_share) >= threshold
        return not x.around and (_stays(x, threshold, size) or _is_section(x, child))

    stay = [i for i, x in enumerate(up.items) if kept(i, x)]
    first, last = stay[0], stay[-1]
    for i, x in enumerate(up.items):
        inner = first <= i <= last
        if isinstance(x, str):
            if not inner:
                up.items[i] = "\n"
        elif x is child or x.around:
            continue
        elif inner or (x.tag in HEADINGS and i < first and 2 * x.link_chars <= x.chars):
            if i not in stay and _is_list(x, threshold):
                x.around = True
            for y in _inside(x):
                if _is_list(y, threshold):
                    y.around = True
        else:
            x.around = True


def _is_section(x: Node, child: Node) -> bool:
    """A heading and plain paragraphs under it, built as ``child`` is, and not the readers' part."""
    if x.tag != child.tag or x.link_chars:
        return False
    inner = [y for y in x.items if not isinstance(y, str) and y.chars]
    if len(inner) < 2 or inner[0].tag not in HEADINGS or any(y.around or y.tag not in PARAGRAPHS | HEADINGS for y in inner):
        return False
    return not _READERS.search("".join(blocks(inner[0])))


def _narrower(node: Node) -> Node | None:
    """The child that holds most of the node's text, in blocks of its own."""
    children = [x for x in node.items if not isinstance(x, str) and not x.around]
    total = sum(map(_plain, children)) + sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
    for x in children:
        if x.tag not in PARAGRAPHS and 2 * _plain(x) > total:
            return x if any(not isinstance(y, str) and y.tag in BLOCKS and not y.around and y.chars for y in x.items) else None
    return None


def _inside(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in x.items if not isinstance(y, str) and not y.around]


def _is_list(x: Node, threshold: float) -> bool:
    return x.tag in BLOCKS and x.links >= LIST_LINKS and 2 * x.link_chars > x.chars and x.density < threshold


def _stays(x: Node, threshold: float, size: float) -> bool:
    """A node beside the main subtree's path is text of the article by itself."""
    if 2 * x.link_chars > x.chars or x.tag in HEADINGS:
        return False
    return x.density >= threshold and (x.tag in PARAGRAPHS or _plain(x) >= size)


def blocks(node: Node) -> Iterator[str]:
    """Texts of a subtree's blocks, in page order."""
    parts: list[str] = []

    def text() -> str:
        joined = _SPACES.sub(" ", "".join(parts)).strip()
        parts.clear()
        return joined

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:  # a block's border
            if joined := text():
                yield joined
        elif isinstance(x, str):
            parts.append(html.unescape(x) if "&" in x else x)
        elif not x.around or x is node:
            border = x.tag in BLOCKS
            stack += ([None] if border else []) + x.items[::-1] + ([None] if border else [])
        elif x.tag in BLOCKS or x.tag == "button":
            stack.append(None)
    if joined := text():
        yield joined


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by empty lines."""
    return "\n\n".join(blocks(main_subtree(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

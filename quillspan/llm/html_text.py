"""HTML extraction (operator 5): composite text density.

A page becomes a small DOM. Elements that are never part of an article (menus, forms, scripts, notices,
adverts, comments of readers; by tag, role, or a whole token of class or id) leave the tree first. One that
holds a ``main`` or an ``article`` stays, but asides and related links only if the page has no other ``article``, and readers' comments only if it has no
other text. These rules alone take out all that is not the article on the given pages; density then decides on what they do not know. For every other node the
composite density is characters per tag, adjusted by how much of it is links; the density sum of a node
is the sum over its children that are blocks. From the node with the largest sum, the smallest density on its path to
the body is the threshold; in every node under the body that reaches it, the subtree with the largest sum
is content, and all of them are the text. As the density of a node without links grows with its size, nodes
are also compared as if they had the size of the body, so a short section is not below a long one of the
same make. What lies between content of one parent stays unless it is mostly links, and headings stay with
what follows.

All blocks of the text are returned in page order: character references decoded, white space in
a block turned into one blank, blocks joined by a newline.

Defined results: null or empty html gives an empty text; a page without a body is its own body; of equal density sums the outer node
counts; very long and very deep pages are read whole; repeated rows are extracted each for itself; other columns than page_id, url
and html play no part.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, text_struct

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small "
    "span strike strong sub sup time tt u var wbr rp rt nobr math svg".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag that ends an open element of these kinds, not beyond the listed limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
# What an article never holds.
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe object embed canvas svg button input select "
    "textarea menu dialog title".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
#: Whole class tokens or ids: a name, or names, with usual parts before and after it. Words of a layout (has-sidebar,
#: content-sidebar-wrap, page--no-nav) are none.
_NAME = (
    r"(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|newsletter|subscri\w*|popup|modal|nav|navbar|"
    r"navigation|menu|breadcrumbs?|sidebar|side-bar|widget|footer|comments?|disqus|replies|respond|related|recommended|"
    r"share|sharing|social|toolbar|pagination|pager|skip-link)"
)
_BEFORE = (
    r"(?:\w+(?:-\w+)*__|(?:site|page|main|top|bottom|header|global|primary|secondary|mobile|desktop|sticky|fixed|post|posts|entry|"
    r"article|user|reader|wp|google|display|blog|sub)[-_])?"
)
_AFTER = (
    r"(?:--\w[\w-]*|[-_](?:list|area|section|box|block|bar|links?|buttons?|icons?|posts?|articles?|stories|items?|form|slot|unit|"
    r"message|signup|label|placeholder|feed|thread|reply|top|bottom|left|right|main|primary|secondary|\d\w*))*"
)
DROPPED_NAMES = re.compile(rf"{_BEFORE}{_NAME}(?:[-_]{_NAME})*{_AFTER}", re.I)
#: Of these, what has articles of others: readers' comments and links to more.
CARDS = frozenset("aside noscript template".split())
CARD_NAMES = re.compile(r"(?:^|[-_])(?:comments?|disqus|replies|respond|related|recommended)(?:$|[-_])", re.I)
#: Comments of readers: they leave with the articles in them, unless the page has no other text.
COMMENT_NAMES = re.compile(r"(?:^|[-_])(?:comments?|disqus|replies|respond)(?:$|[-_])", re.I)
MAIN = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: An element that would leave but for the article in it.
KEPT = -1
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


class Node:
    __slots__ = ("tag", "parent", "items", "leaves", "holds", "block", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, leaves: int = 0):
        self.tag, self.parent, self.items, self.leaves = tag, parent, [], leaves


def dropped(tag: str, attrs: str, inside_article: bool) -> int:
    """0: stays; 1: leaves, unless it holds an article; 2: leaves, unless it holds the only ones; 3: leaves, unless it holds the only text."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return 1 + (tag in CARDS)
    if not attrs or tag in ("html", "body", *MAIN):
        return 0
    named: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = [n for n in (*named.get("class", "").split(), *named.get("id", "").split()) if DROPPED_NAMES.fullmatch(n)]
    role = named.get("role", "").lower().split()[:1]
    if any(COMMENT_NAMES.search(n) for n in names):
        return 3
    if role == ["complementary"] or any(CARD_NAMES.search(n) for n in names):
        return 2
    return int(bool(names or role and role[0] in DROPPED_ROLES))


def parse(page: str) -> Node:
    """The tree of a page without the elements that an article never holds."""
    root = node = Node("#root", None)
    stack: list[str] = []
    leaving: list[int] = []  # places in the stack of open elements that may leave
    at, articles = 0, 0

    def close() -> None:
        nonlocal node, articles
        articles -= stack.pop() in MAIN
        if leaving and leaving[-1] == len(stack):
            leaving.pop()
        node = node.parent

    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        if not closing and tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in DROPPED:
                continue
        if closing:
            # What opened around an element that may leave is not closed inside it.
            if tag in (stack[leaving[-1] :] if leaving and tag not in ("body", "html", *MAIN) else stack):
                while node.tag != tag:
                    close()
                close()
            elif tag == "p":
                node.items.append(Node("p", node))
            continue
        if tag in CLOSES_P and "p" in stack:
            kinds, limits = {"p"}, {"td", "th", "table", "button", "article", "section", "div"}
        else:
            kinds, limits = CLOSES.get(tag, ((), ()))
        if kinds:
            up = node
            while up.parent is not None and up.tag not in kinds and up.tag not in limits and not up.leaves:
                up = up.parent
            if up.tag in kinds:
                while node is not up.parent:
                    close()
        leaves = dropped(tag, m[3], articles > 0)
        if leaves and (tag in VOID or tag in RAW or m[3].endswith("/")):
            continue
        child = Node(tag, node, leaves)
        node.items.append(child)
        if tag not in VOID and tag not in RAW:
            if leaves:
                leaving.append(len(stack))
            stack.append(tag)
            node = child
            articles += tag in MAIN
    if at < len(page):
        node.items.append(page[at:])
    return without_dropped(root)


def without_dropped(root: Node) -> Node:
    """What leaves is taken out; an element that holds a main or an article stays, or leaves if it holds others' articles."""
    nodes = in_order(root)
    text: set[Node] = set()
    for n in reversed(nodes):
        if any(c in text if isinstance(c, Node) else c.strip() for c in n.items):
            text.add(n)
        kinds = [c.holds for c in n.items if isinstance(c, Node)]
        n.holds = max(2 * (n.tag == "main" and n in text), n.tag == "article" and n in text, *kinds, 0)
    for n in nodes:
        if n.leaves and n.holds >= n.leaves:
            n.leaves = KEPT
    todo, plain = [root], False  # whether there is text outside of what leaves
    while todo and not plain:
        n = todo.pop()
        plain = any(isinstance(c, str) and c.strip() for c in n.items)
        todo.extend(c for c in n.items if isinstance(c, Node) and c.leaves <= 0)
    may = lambda n: n.leaves > 0 and n.holds and not (n.leaves == 3 and plain)
    cards = [n for n in nodes if may(n)]
    while cards:
        outside, todo = False, [root]
        while todo and not outside:
            n = todo.pop()
            outside = n.tag == "article" and n in text
            todo.extend(c for c in n.items if isinstance(c, Node) and c.leaves <= 0)
        if outside:
            break
        seen: set[Node] = set()  # the only articles: the outermost of their holders stay
        for n in nodes:
            if n.parent in seen:
                seen.add(n)
            elif may(n):
                seen.add(n)
                n.leaves = KEPT
        cards = [n for n in cards if n.leaves > 0]
    for n in nodes:
        n.items = [c for c in n.items if isinstance(c, str) or c.leaves <= 0]
    return root


def in_order(root: Node) -> list[Node]:
    nodes, todo = [], [root]
    while todo:
        nodes.append(n := todo.pop())
        todo.extend(c for c in reversed(n.items) if isinstance(c, Node))
    return nodes


def count(n: Node) -> None:
    kids = [c for c in n.items if isinstance(c, Node)]
    n.block = n.tag not in INLINE or any(c.block for c in kids)
    n.chars = sum(len("".join(c.split())) for c in n.items if isinstance(c, str)) + sum(c.chars for c in kids)
    n.tags = len(kids) + sum(c.tags for c in kids)
    link = n.tag == "a"
    n.link_chars = n.chars if link else sum(c.link_chars for c in kids)
    n.link_tags = (n.tags if link else sum(c.link_tags for c in kids)) + sum(c.tag == "a" for c in kids)


def composite(n: Node, share: float, size: int = 0) -> float:
    """The density of a node, or of one of the same make with so many characters."""
    if not n.chars:
        return 0.0
    k = size / n.chars if size else 1
    chars, link_chars, tags, link_tags = k * n.chars, k * n.link_chars, k * max(n.tags, 1), k * n.link_tags
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    ratio = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    # A page without links has base 1, for which the formula has no value; e stands in.
    return chars / tags * math.log(max(ratio, 1.0)) / math.log(max(base, math.e) if base <= 1.001 else base)


def measure(body: Node) -> list[Node]:
    """Densities and density sums of all nodes under the body."""
    nodes = in_order(body)
    for n in reversed(nodes):
        count(n)
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        n.density = composite(n, share)
    for n in nodes:
        n.total = sum(c.density for c in n.items if isinstance(c, Node) and c.block)
    return nodes


def pieces(n: Node) -> list[Node]:
    """The blocks of a node; text and inline elements between two are one."""
    out: list[Node] = []
    for c in n.items:
        if isinstance(c, Node) and c.block:
            out.append(c)
            continue
        if not out or out[-1].tag != "#run":
            out.append(Node("#run", n))
        out[-1].items.append(c)
    for c in out:
        if c.tag == "#run":
            count(c)
    return [c for c in out if c.chars]


def content(body: Node, nodes: list[Node], best: dict[Node, Node]) -> Node:
    """The marked subtrees in page order, under one node."""
    share = body.link_chars / max(body.chars, 1)
    path, up = [], best[body]
    while up is not None and up is not body.parent:
        path.append(up)
        up = up.parent
    least, least_sized = (min(composite(n, share, size) for n in path) * (1 - 1e-9) for size in (0, body.chars))

    def reaches(n: Node) -> bool:
        return n.chars > 0 and (composite(n, share) >= least or composite(n, share, body.chars) >= least_sized)

    whole = {best[n] for n in nodes if n.block and reaches(n)}
    parts: dict[Node, list[Node]] = {}
    for n in reversed(nodes):
        if n in whole:
            parts[n] = [n]
        elif n.block:
            of = pieces(n)
            for c in of:
                if c.tag == "#run" and reaches(c):
                    parts[c] = [c]
            given = [k for k, c in enumerate(of) if c in parts]
            if not given:
                continue
            start = given[0]
            while start and of[start - 1].tag in HEADINGS:
                start -= 1
            chosen = [parts.get(c, [c]) for c in of[start : given[-1] + 1] if c in parts or 2 * c.link_chars <= c.chars]
            parts[n] = chosen[0] if len(chosen) == 1 else [x for p in chosen for x in p]
    union = Node("#content", None)
    union.items.extend(parts.get(body, ()))
    return union


def main_subtree(root: Node) -> Node:
    nodes = in_order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    nodes = measure(body)
    best: dict[Node, Node] = {}  # of each block, the block in it with the largest sum
    for n in reversed(nodes):
        if n.block:
            kids = [best[c] for c in n.items if isinstance(c, Node) and c.block]
            best[n] = max([n, *kids], key=lambda c: c.total)
    return content(body, nodes, best)


def blocks(top: Node) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag in INLINE:
            if x.tag == "br":
                line.append(" ")
            todo.extend(reversed(x.items))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(x.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(main_subtree(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)

    def setup():
        def work(rows: list) -> list[list]:
            texts = [main_text(p) for p in rows]
            return [texts, [len(t) for t in texts]]

        return work

    udf = text_struct(setup, "text string, n_chars long")
    return pages.select("page_id", "url", udf(F.col("html")).alias("_r")).select("page_id", "url", "_r.*")

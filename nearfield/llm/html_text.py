"""Main text of web pages by composite text density.

A page is parsed into a tree. Elements that are no content by their kind
(navigation, forms, scripts and the like) or hidden are left out. A class, id
or role (adverts, comments, cookie notices and the like) is a hint, and what
holds an article or main element (other than a comment) is never left out for
one. A whole name ("ad") counts where the page has such an element elsewhere.
All other hints ("tag-news") count for what holds no more than half of the
remaining text, and none of them where together they would leave less. Every other
node gets a density: characters per tag, adjusted by how much of them is
links, against the share of links in the whole body. The node whose children's
densities sum highest is the middle of the content. The lowest density on its
way up to the body is the threshold: every other part of the body above it
gives the subtree with the highest sum in it. An enclosing article or main
element of a found subtree is content as a whole.

Character references are decoded, white space becomes one space, blocks are
joined by one space in the order of the page. Null and empty pages give an
empty text; a page cut off anywhere is parsed as far as it goes; repeated
pages give equal texts; other columns are left alone.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|</?[a-zA-Z][^>]*+>", re.S)
#: Names and values of attributes; quoted strings without a name are skipped.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
#: HTML's element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_NOT_CONTENT = _RAW | frozenset("head nav header footer aside form button select option label fieldset dialog menu svg math canvas object audio video picture map".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: Parts of class, id and role names of what is no content.
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adbox|adsense|banners?|sponsor(?:ed)?|promos?|promotion|navi?|navbar|navigation|menus?|breadcrumbs?|"
    r"sidebars?|aside|widgets?|footers?|headers?|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|replies|reply|cookies?|consent|gdpr|notices?|notification|alerts?|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|pagination|pager|skip|tags?|tagcloud|legal|disclaimer|"
    r"contentinfo|complementary|hidden|toc)(?:$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond)(?:$|[\s_-])", re.I)


class Node:
    """``hint``: 2 if a whole name is one of what is no content, 1 if a part
    of one is; ``main``: an element of content."""

    __slots__ = ("tag", "up", "parts", "out", "hint", "main", "chars", "tags", "link_chars", "link_tags", "density", "sum", "at", "end")

    def __init__(self, tag: str, up: Node | None, out: bool, hint: int = 0, main: bool = False):
        self.tag, self.up, self.out, self.hint, self.main, self.parts = tag, up, out, hint, main, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.at = self.end = 0  # the node's place on the page, and the first behind its subtree


def _judged(tag: str, attrs: str) -> tuple[bool, int, bool]:
    """Whether an element is out, how it is hinted to be, and whether it is an
    article or main."""
    if tag in _NOT_CONTENT:
        return True, 0, False
    main = tag in ("article", "main")
    if not attrs or tag in ("body", "html"):
        return False, 0, main
    values: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        if m[1]:
            values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of equal names
    names = [values[n] for n in ("class", "id", "role") if values.get(n)]
    if main:
        return False, 0, not any(_COMMENT.search(n) for n in names)
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True, 0, False
    hint = max((2 if m[0].strip() == word else 1 for n in names for word in n.split() if (m := _BOILERPLATE.search(word))), default=0)
    return False, hint, values.get("role", "").lower() in ("article", "main")


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, parents before children. A node's ``parts`` are
    texts and nodes in order."""
    root = Node("#root", None, False)
    nodes, here, at = [root], root, 0
    open_: Counter[str] = Counter()  # elements that are open, so nothing is looked for in vain

    def left(to: Node) -> Node:
        """Closes all elements below ``to``."""
        x = here
        while x is not to:
            open_[x.tag] -= 1
            x = x.up
        return to

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                up = here
                while up.tag != tag:
                    up = up.up
                here = left(up.up)
            continue
        ends, inside = _ENDS.get(tag, ("", ""))
        if tag in _P_ENDS:
            ends, inside = "p", "article section div td th li button main body blockquote figure aside form object"
        if ends and any(open_[x] > 0 for x in ends.split()):
            up, stop = here, inside.split()
            last = None
            while up.up and up.tag not in stop:
                if up.tag in ends.split():
                    last = up
                    if tag in _P_ENDS:
                        break
                up = up.up
            if last:
                here = left(last.up)
        out, hint, main = _judged(tag, m[3])
        node = Node(tag, here, here.out or out, hint, main)
        here.parts.append(node)
        nodes.append(node)
        if tag in _RAW:
            close = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in _VOID and not m[3].endswith("/"):
            here = node
            open_[tag] += 1
    for k, n in enumerate(nodes):
        n.at = n.end = k
    for n in reversed(nodes):
        n.end = max(n.end, n.at + 1)
        if n.up:
            n.up.end = max(n.up.end, n.end)
    return root, nodes


def _sizes(nodes: list[Node]) -> tuple[dict[Node, int], dict[Node, int]]:
    """Characters and elements of content in each subtree that is not out."""
    size, mains = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n in reversed(nodes):
        if n.out:
            continue
        size[n] += sum(len(" ".join(x.split())) for x in n.parts if isinstance(x, str))
        mains[n] += n.main and size[n] > 0
        if n.up:
            size[n.up] += size[n]
            mains[n.up] += mains[n]
    return size, mains


def _follow_hints(nodes: list[Node], body: Node) -> None:
    """Leaves out what is hinted to be no content, within the bounds above."""
    if not any(n.hint and not n.out for n in nodes):
        return
    size, mains = _sizes(nodes)
    around = dict.fromkeys(nodes, 0)  # elements of content that a node is in
    for n in nodes:  # parents first
        if n.up:
            around[n] = around[n.up] + (n.up.main and size[n.up] > 0)
            n.out = n.out or n.up.out or n.hint == 2 and not mains[n] and mains[nodes[0]] > around[n]
    if not any(n.hint and not n.out for n in nodes):
        return
    size, mains = _sizes(nodes)
    gone, left = set(), size[body]
    for n in nodes:
        if n.out:
            continue
        if n.up in gone:
            gone.add(n)
        elif n.hint and not mains[n] and 2 * size[n] <= size[body]:
            gone.add(n)
            left -= size[n] if _inside(n, body) else 0
    if 2 * left >= size[body]:
        for n in gone:
            n.out = True


def _measure(nodes: list[Node]) -> Node:
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    _follow_hints(nodes, body)
    for n in reversed(nodes):
        if n.out:
            continue
        n.chars += sum(len(" ".join(x.split())) for x in n.parts if isinstance(x, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n.up:
            n.up.chars += n.chars
            n.up.tags += n.tags + 1
            n.up.link_chars += n.link_chars
            n.up.link_tags += n.link_tags
    share = body.link_chars / max(1, body.chars)
    for n in reversed(nodes):
        if n.out or not n.chars:
            continue
        tags, links, link_tags = max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        plain = max(1, n.chars - n.link_chars)
        base = math.log(n.chars / plain * links + share * n.chars + math.e)
        n.density = n.chars / tags * max(0.0, math.log(n.chars / links * tags / link_tags + 1e-9, max(base, 1.1)))
        if n.up:
            n.up.sum += n.density
    return body


def _inside(node: Node, top: Node) -> bool:
    return top.at <= node.at < top.end


def content(nodes: list[Node], body: Node) -> list[Node]:
    """The subtrees with the main text, in the order of the page."""
    mine = [n for n in nodes if not n.out and n.chars and _inside(n, body)]
    if not mine:
        return []
    middle = max(mine, key=lambda n: n.sum if n.sum else n.density if n.up is None else 0.0)
    path, up = [middle.density], middle
    while up is not body:
        up = up.up
        path.append(up.density)
    least = min(path)

    # the outermost article or main that a node is in, or itself
    around: dict[int, Node] = {}
    for n in nodes[body.at : body.end]:
        outer = around.get(n.up.at) if n is not body and n.up else None
        if outer is not None or n.tag in ("article", "main"):
            around[n.at] = outer or n

    first = around.get(middle.at, middle)
    found, at = [first], [n.at for n in mine]
    until = 0  # behind the subtrees that were found so far
    for k, n in enumerate(mine):  # in order of the page, parents first
        if n.at < until or _inside(n, first) or _inside(first, n):
            continue
        if n is not body and n.density >= least and n.tag not in _INLINE:
            best = max(mine[k : bisect_left(at, n.end)], key=lambda x: x.sum)
            found.append(around.get((best if best.sum > 0 else n).at, best if best.sum > 0 else n))
            until = max(n.end, found[-1].end)
    return sorted({f.at: f for f in found}.values(), key=lambda n: n.at)


def _pieces(node: Node, out: list[str]) -> None:
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.out:
            block = x.tag not in _INLINE
            if block:
                out.append("\n")
                todo.append("\n")
            todo += reversed(x.parts)


def main_text(page: str | None) -> str:
    _, nodes = parse(page or "")
    for n in nodes:
        n.parts = [html.unescape(x) if isinstance(x, str) else x for x in n.parts]
    out: list[str] = []
    for n in content(nodes, _measure(nodes)):
        _pieces(n, out)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """The columns ``keep``, text and n_chars (its code points)."""
    held = pages.select(F.struct(*keep).alias("row"), F.col(page).alias("html"))
    inner = held.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["row", "text", "n_chars"])

    return held.mapInArrow(run, f"row {inner}, text string, n_chars long").select("row.*", "text", "n_chars")

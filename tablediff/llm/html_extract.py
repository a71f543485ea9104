"""Main text of web pages by composite text density.

Each page's elements become a tree. For every node the composite text density compares its characters
with its tags, adjusted for how much of either stands in links; a node's density sum adds up the densities
of its children, its own text counted as one of them. The node of the largest sum in the body names a threshold: the least
density on its path up to the body. Its subtree is main text, and so is, in every other branch that reaches the threshold,
the subtree of the largest sum. A chosen subtree grows to its parent below the body while all that stands beside it there
belongs to it: headings, and what is not mostly links and reaches the threshold or is a paragraph. Where it does not grow,
such neighbours that touch it come along by themselves. A box in a chosen element that is mostly links is left out. No element is main text by its name.

Beforehand navigation, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are cut out by element and role. A word of class or id cuts by itself only if the whole name says
nothing else (social-share, not social-science); in a longer name it cuts what is mostly links. If class words would
leave a page without text they do not count.

Cases: null and empty html, and pages without text, give an empty string. Broken markup is read as
browsers do: missing end tags are implied, stray ones ignored, unclosed comments and scripts run to the end; a quote
that is never closed is a character like any other. Reading takes time in proportion to the markup, however it is broken and
however deep it nests. Of equal sums the first in page order counts. Repeated rows give equal results, null ids and urls are
kept, extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, released

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start closes an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start of the key closes an open element of the values, up to the boundary.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"})}
#: Elements and roles that never hold main text; words of class or id that tell of such; words that add nothing beside one.
CUT = frozenset("head script style noscript template iframe object embed svg canvas audio video nav footer aside form button select input textarea menu dialog title link meta".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer cookie cookies consent gdpr banner notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus discussion replies respond widget toolbar pagination pager masthead copyright disclaimer paywall".split())
PLAIN_WORDS = frozenset("area bar block bottom box button buttons center col column container content div footer global header holder info inner item items left links list main message outer page panel placeholder policy posts primary right row secondary section site slot stories sub text top unit wrap wrapper".split())
#: Elements that hold running text, and the share of characters in links above which a block is taken for a list of links.
PARAGRAPHS = frozenset("p pre blockquote ul ol dl figure table".split())
LINK_SHARE = 1 / 3
BOXES = frozenset("div section center table".split())

MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[^\s/>]++")
IN_TAG = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
CAMEL, MARK = re.compile(r"([a-z])([A-Z])"), re.compile(r"[a-z]+", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("name", "parent", "parts", "cut", "doubt", "chars", "tags", "link_chars", "link_tags", "density", "weight", "own", "at", "end")

    def __init__(self, name: str, parent: Node | None, cut: bool, doubt: int = 0):
        self.name, self.parent, self.cut, self.doubt, self.parts = name, parent, cut, doubt, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = self.at = self.end = 0
        self.density = self.weight = 0.0


#: What class and id say: nothing, a cut word among others, or only cut words.
NO_DOUBT, DOUBTFUL, NAMED = range(3)


def _named(value: str) -> int:
    found = NO_DOUBT
    for name in value.split():
        words = [w.lower() for w in MARK.findall(CAMEL.sub(r"\1 \2", name))]
        if any(w in CUT_WORDS for w in words):
            if all(w in CUT_WORDS or w in PLAIN_WORDS for w in words):
                return NAMED
            found = DOUBTFUL
    return found


def _judge(name: str, attributes: str, in_text: bool) -> tuple[bool, int]:
    """Whether an element is cut, and what its class and id say."""
    if name in CUT or name == "header" and not in_text:
        return True, NO_DOUBT
    if not attributes or name in ("html", "body", "article", "main"):
        return False, NO_DOUBT
    doubt = NO_DOUBT
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            doubt = max(doubt, _named(value))
        elif key == "role" and value.strip().lower() in CUT_ROLES or key == "style" and HIDDEN.search(value) or key == "aria-hidden" and value.lower() == "true" or key == "hidden" and value.lower() != "until-found":
            return True, NO_DOUBT
    return False, doubt


class _Markup:
    """Reads a page from left to right; what was not found to the end of the page is not looked for again."""

    def __init__(self, text: str):
        self.text, self.lost = text, set()

    def after(self, what: str, at: int) -> int:
        """Where the next what at or after at ends; the end of the page, if there is none."""
        found = -1 if what in self.lost else self.text.find(what, at)
        if found < 0:
            self.lost.add(what)
            return len(self.text)
        return found + len(what)

    def tag_end(self, at: int) -> int:
        """Where the tag that holds at ends. A quoted value may hold what ends a tag."""
        while (m := IN_TAG.search(self.text, at)) is not None:
            if m[0] == ">":
                return m.end()
            at = m.end()
            if m[0] not in self.lost:
                closed = self.after(m[0], at)
                if m[0] not in self.lost:
                    at = closed
        return len(self.text)

    def raw_end(self, name: str, at: int) -> tuple[int, int]:
        """Where the end tag of a raw element begins and ends."""
        key = "</" + name
        if key not in self.lost:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(self.text, at)
            if end:
                return end.start(), self.after(">", end.end())
            self.lost.add(key)
        return len(self.text), len(self.text)


class _Open:
    """The open elements. Counts of names, for the page and for each block, tell what is not there without a search."""

    def __init__(self, root: Node):
        self.nodes, self.names, self.scopes = [root], Counter(), [(0, Counter())]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.names[node.name] += 1
        if node.name in BLOCKS or node.name == "button":
            self.scopes.append((len(self.nodes) - 1, Counter()))
        else:
            self.scopes[-1][1][node.name] += 1

    def close(self, index: int) -> None:
        while len(self.nodes) > index:
            node = self.nodes.pop()
            self.names[node.name] -= 1
            if self.scopes[-1][0] == len(self.nodes):
                self.scopes.pop()
            else:
                self.scopes[-1][1][node.name] -= 1

    def last(self, names) -> int:
        """The place of the last open element of names; they must be there."""
        return next(i for i in range(len(self.nodes) - 1, 0, -1) if self.nodes[i].name in names)

    def end_tag(self, name: str) -> None:
        if name in HEADINGS:
            if any(self.names[x] for x in HEADINGS):
                self.close(self.last(HEADINGS))
        elif self.names[name] if name in BLOCKS or name == "button" else self.scopes[-1][1][name]:  # an inline end tag reaches no further than its block
            self.close(self.last((name,)))

    def before(self, name: str) -> None:
        """Closes what the start of name closes."""
        if name in ENDS_P and self.nodes[self.scopes[-1][0]].name == "p":
            self.close(self.scopes[-1][0])
        if name in IMPLIED:
            ends, bound = IMPLIED[name]
            left = sum(self.names[x] for x in ends)
            lowest, i = 0, len(self.nodes) - 1
            while left and i > 0 and self.nodes[i].name not in bound:
                if self.nodes[i].name in ends:
                    lowest, left = i, left - 1
                i -= 1
            if lowest:
                self.close(lowest)
        if name == "body" and self.names["head"]:
            self.close(self.last(("head",)))


def parse(text: str) -> Node:
    """The element tree. Text stands as strings among a node's parts."""
    root = Node("html", None, False)
    open_, markup, position, n = _Open(root), _Markup(text), 0, len(text)
    while position < n:
        m = MARKUP.search(text, position)
        at = open_.nodes[-1]
        if m is None:
            at.parts.append(text[position:])
            break
        if m.start() > position:
            at.parts.append(text[position : m.start()])
        mark = m[0]
        if mark == "<!--":
            position = markup.after("-->", m.end())
            continue
        if mark == "<![CDATA[":
            position = markup.after("]]>", m.end())
            at.parts.append(text[m.end() : position].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if mark in ("<!", "<?"):
            position = markup.after(">", m.end())
            continue
        named = NAME.match(text, m.end() - 1)
        name, position = named[0].lower(), markup.tag_end(named.end())
        if mark[1] == "/":
            if name not in ("html", "body"):
                open_.end_tag(name)
            continue
        open_.before(name)
        if name == "html" or name == "body" and open_.names["body"]:
            continue
        at = open_.nodes[-1]
        attributes = text[named.end() : position].removesuffix(">")
        cut, doubt = _judge(name, attributes, any(open_.names[x] for x in ("article", "main", "section")))
        node = Node(name, at, at.cut or cut, doubt)
        at.parts.append(node)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            end, after = markup.raw_end(name, position)
            node.parts.append(text[position:end])
            position = after
            continue
        open_.push(node)
    return root


def _order(root: Node) -> list[Node]:
    """All nodes that are not cut, parents before children; each knows where its subtree begins and ends."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.cut:
            continue
        node.at = node.end = len(out)
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    for node in reversed(out):
        node.end = max(node.end, node.at + 1)
        if node.parent is not None:
            node.parent.end = max(node.parent.end, node.end)
    return out


def _count(nodes: list[Node]) -> None:
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(nodes):
        node.own = sum(len(w) for p in node.parts if isinstance(p, str) for w in p.split())
        node.chars += node.own
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags


def _cut_doubtful(root: Node) -> list[Node]:
    """The nodes that are left when class and id have had their say."""
    nodes = _order(root)
    _count(nodes)
    doubted = [x for x in nodes if x.doubt == NAMED or x.doubt == DOUBTFUL and x.link_chars > LINK_SHARE * x.chars]
    if not doubted:
        return nodes
    for x in doubted:
        x.cut = True
    left = _order(root)
    _count(left)
    if left[0].chars:
        return left
    for x in doubted:
        x.cut = False
    nodes = _order(root)
    _count(nodes)
    return nodes


def _measure(nodes: list[Node], body: Node) -> None:
    whole, links = max(body.chars, 1), body.link_chars
    for node in nodes:
        node.density = node.weight = 0.0
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if not c:
            continue
        base = math.log(c * lc / max(c - lc, 1) + links * c / whole + math.e)
        node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base
        node.weight = node.density * node.own / c
    for node in nodes:
        if node.parent is not None:
            node.parent.weight += node.density


def _within(node: Node, other: Node) -> bool:
    return other.at <= node.at < other.end


def _children(node: Node) -> list[Node]:
    return [p for p in node.parts if isinstance(p, Node) and not p.cut]


def main_node(root: Node) -> tuple[Node, float]:
    """The node of the largest sum, and the threshold that it names."""
    top, threshold, _, _ = _main(root)
    return top, threshold


def _main(root: Node) -> tuple[Node, float, Node, list[Node]]:
    nodes = _cut_doubtful(root)
    body = next((x for x in nodes if x.name == "body"), root)
    _measure(nodes, body)
    top = max(nodes[body.at : body.end], key=lambda x: x.weight)
    threshold, node = top.density, top
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    return (top if top.weight > 0 else body), threshold, body, nodes


def content(root: Node) -> list[Node]:
    """The subtrees of main text, in page order; none lies in another."""
    top, threshold, body, nodes = _main(root)
    best = {}  # the node of the largest sum in each subtree
    for node in reversed(nodes):
        best[node] = max([node, *(best[p] for p in _children(node))], key=lambda x: x.weight)
    taken, stack = {top}, [body]
    while stack:
        node = stack.pop()
        if node in taken or _links(node) and not _within(top, node) and node.chars < top.chars:
            continue
        if not _within(top, node) and node.density >= threshold > 0:
            taken.add(best[node])
            if best[node] is node:
                continue
        stack += _children(node)
    grown = set()
    for node in taken:
        grown.update(_grown(node, body, threshold))
    out: list[Node] = []
    for node in sorted(grown, key=lambda x: x.at):
        if not out or not _within(node, out[-1]):
            out.append(node)
            for x in _children(node):
                if _links(x) and 2 * x.chars < node.chars:
                    x.cut = True
    return out


def _links(node: Node) -> bool:
    """Whether the node is a box of links beside the text."""
    return node.name in BOXES and node.link_chars > LINK_SHARE * node.chars


def _holds_paragraphs(node: Node) -> bool:
    """Whether all text of the node stands in headings and paragraphs within it."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.chars and x.name not in HEADINGS and x.name not in PARAGRAPHS:
            below = _children(x)
            if not below or any(isinstance(p, str) and p.strip() for p in x.parts):
                return False
            stack += below
    return True


def _grown(node: Node, body: Node, threshold: float) -> list[Node]:
    """The node as large as what stands beside it allows, and else with the neighbours that belong to it."""

    def belongs(x: Node) -> bool:
        return not x.chars or x.name in HEADINGS or x.link_chars <= LINK_SHARE * x.chars and (x.name in PARAGRAPHS or x.density >= threshold > 0 or _holds_paragraphs(x))

    def near(side: Iterable[Node]) -> Iterator[Node]:
        """Neighbours that belong, from the node outwards, with short ones without many links that stand between."""
        between = []
        for x in side:
            if belongs(x):
                yield from between
                yield x
                between = []
            elif x.link_chars <= LINK_SHARE * x.chars and x.chars < node.chars:
                between.append(x)
            else:
                return

    while node is not body and node.name not in BLOCKS:
        node = node.parent
    while node is not body and node.parent is not body and node.parent is not None and all(x is node or belongs(x) for x in _children(node.parent)):
        node = node.parent
    if node is body or node.parent is None:
        return [node]
    beside = _children(node.parent)
    at = beside.index(node)
    return [node, *near(reversed(beside[:at])), *near(beside[at + 1 :])]


def blocks(node: Node) -> list[str]:
    """Text of each block in page order, white space inside it as one space."""
    out: list[str] = []
    own: list[str] = []

    def end() -> None:
        line = " ".join(entities.unescape("".join(own)).split())
        if line:
            out.append(line)
        own.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            own.append(x)
        elif x is None:
            end()
        elif not x.cut:
            if x.name == "br":
                own.append(" ")
            elif x.name in BLOCKS:
                end()
                stack.append(None)
            stack += reversed(x.parts)
    end()
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(line for node in content(parse(html)) for line in blocks(node))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(released(run), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))

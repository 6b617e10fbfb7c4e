"""Main text of web pages by tree scoring.

Boilerplate elements (by tag, or by a word of their class, id or role) are left out. Every paragraph-like element with text of its own earns
points for its length and its commas, which count in full for its parent, half for its grandparent and less further up. A
container's points are discounted by the share of its text that stands in links. The best container is kept whole, or the outermost article or
main element around it. Lists of links stay in an article or main element; in another container only as list elements in its text, and not where
it is the page itself or a frame such as a table.

What stands beside it, and beside each element around it, is judged. A container is kept if it has a fifth of the best one's points or holds
sentences; one that is mostly links, or bare words without a sentence, is not: adverts and teasers need no name to go. Within the same inner element as the
best container, short paragraphs, code, figures and bare text always stay; farther off, and beside an article element, a paragraph has to be a
sentence or long, and single links go. Headings stay. Text is given block by block, in page order.

Form controls are left out. A form itself is a container like others if it holds the best container or an article or main element, has no
control that shows, or earns more points than it has such controls; any other form is boilerplate with all that it holds.

Blocks are joined by two line breaks; white space within a block becomes one space; character references are decoded; a line-break element is
white space. Unclosed elements end where HTML ends them: a new paragraph closes an open one with whatever inline elements it left open.

Defined results: null and empty pages, and pages without text, give an empty text; each row is read by itself, repeated rows and null ids too; an
empty table gives no rows; other columns are not looked at. Element trees are walked without recursion, so depth is not limited.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.tables import field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template head title svg iframe object canvas audio video nav header footer aside button select "
    "option textarea input label fieldset dialog menu".split())
NOTES = frozenset(("annotation", "annotation-xml"))  # a formula's source beside the formula
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure "
    "figcaption address details summary center hr form".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body h1 h2 h3 h4 h5 h6 figcaption form".split())
CONTAINERS = frozenset("html body main article section div td blockquote ul ol dl table tbody form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EXPLICIT = frozenset("p pre blockquote li dd figcaption".split())  # elements that are made for text
LISTS = frozenset("ul ol dl".split())
FRAMES = frozenset("html body form table tbody td".split())  # may be the whole page
SENTENCE = re.compile(r"[^.\u2026\s][.!?\u3002][\"'\u201d\u2019)]*\s*$")  # three dots do not end one
LONG = 80  # characters of a paragraph that needs no full stop
SHARE = 0.2  # of the best container's points, which keep a container beside it
CONTROLS = frozenset("input select textarea button".split())
#: An opening tag of the key ends an open element of the value, up to the nearest boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARIES = frozenset("html body table td th ul ol dl div section article main blockquote".split())
BOILERPLATE = re.compile(
    r"(?:^|[^a-z])(ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|sidebar|side-?bar|breadcrumbs?|header|masthead|footer|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|comments?|"
    r"commentlist|disqus|respond|replies|widget|pagination|pager|login|signup|signin|search|toolbar|copyright|complementary|contentinfo)(?:$|[^a-z])")
NAMED = frozenset({"body", "html", "main", "article"})  # not dropped for their names
LAYOUT = re.compile(r"(?:has|no|with|without)-(?:right-|left-)?[a-z]+")  # says what stands beside an element, not what it is
FRAME_WORDS = frozenset("sidebar side-bar nav navbar menu header footer toolbar".split())  # also found in names of a page's outer frame


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "length", "commas", "linked", "links", "score", "dropped", "by_name", "controls", "holds_main")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool, by_name: str = ""):
        self.tag, self.parent, self.dropped, self.by_name = tag, parent, dropped, by_name
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.length = self.commas = self.linked = self.links = 0
        self.score = 0.0
        self.controls, self.holds_main = 0, False


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None, False)
        self.open = self.root
        self.order = [self.root]
        self.seen_main = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and self.root.children and tag == "html":
            return
        if tag in BLOCKS or tag in DROPPED:
            self._end_paragraph()
        if tag in CLOSES:
            self._end_open(CLOSES[tag])
        if tag in CONTROLS and not (tag == "input" and any(k == "type" and (v or "").lower() == "hidden" for k, v in attrs)):
            self.open.controls += 1
        if tag in VOID:
            self.open.children.append("\n" if tag == "br" else Node(tag, self.open, True))
            return
        if tag in ("main", "article") and not self.seen_main:
            self.seen_main = True
            self._keep_around()
        by_name = self._boilerplate_word(attrs) if tag not in NAMED and tag not in DROPPED else ""
        node = Node(tag, self.open, self.open.dropped or tag in DROPPED or tag in NOTES or by_name != "", by_name or (self.open.by_name if tag not in DROPPED else ""))
        self.open.children.append(node)
        self.order.append(node)
        self.open = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at is not None and at.tag != tag:
            if at.tag in BOUNDARIES and tag not in BLOCKS and tag not in DROPPED:
                return  # a stray end of an inline element
            at = at.parent
        if at is not None and at.parent is not None:
            self.open = at.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)

    def _keep_around(self) -> None:
        """A frame around the page's first main element or article is no boilerplate, even if its name speaks of a sidebar or header."""
        chain, at = [], self.open
        while at is not None and at.dropped and at.by_name in FRAME_WORDS:
            chain.append(at)
            at = at.parent
        if at is None or not at.dropped:
            for node in chain:
                node.dropped = False

    def _end_paragraph(self) -> None:
        at = self.open
        while at is not None and at.tag not in BOUNDARIES and at.tag != "p":
            at = at.parent
        if at is not None and at.tag == "p":
            self.open = at.parent

    def _end_open(self, tags: set[str]) -> None:
        at = self.open
        while at is not None and at.tag not in tags:
            if at.tag in BOUNDARIES and at.tag not in tags:
                return
            at = at.parent
        if at is not None:
            self.open = at.parent

    @staticmethod
    def _boilerplate_word(attrs: list) -> str:
        for name, value in attrs:
            if name in ("class", "id", "role") and value and (found := BOILERPLATE.search(LAYOUT.sub("", value.lower().replace("_", "-")))):
                return found[1]
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "hidden"
        return ""


def own_text(node: Node) -> str:
    """Text of a node and its inline descendants."""
    out, todo = [], [iter(node.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            out.append(child)
        elif not child.dropped and child.tag not in BLOCKS:
            todo.append(iter(child.children))
    return "".join(out)


def measure(order: list[Node]) -> None:
    """Lengths and link lengths of whole subtrees, then the points that paragraphs pass to their ancestors."""
    for node in order:
        node.length = node.commas = node.linked = node.links = 0
        node.score = 0.0
        if not node.dropped and node.tag in PARAGRAPHS:
            text = " ".join(own_text(node).split())
            node.length, node.commas = len(text), text.count(",")
    earning = [n for n in order if not n.dropped and n.tag in PARAGRAPHS and n.length]
    points = [(n, 1 + n.commas + min(n.length / 100, 3)) for n in earning]
    for node in order:
        if node.tag == "a" and not node.dropped:
            length = len(" ".join(own_text(node).split()))
            at = node.parent
            while at is not None and at.tag not in PARAGRAPHS:
                at = at.parent
            if at is not None:
                at.linked += length
                at.links += 1
    for node in reversed(order):  # children come after their parents
        if node.parent is not None and not node.dropped:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.links += node.links
    for node, worth in points:
        at, level = node.parent, 0
        while at is not None and level < 6:
            if at.tag in CONTAINERS:
                at.score += worth / (1, 2, 6, 9, 12, 15)[level]
                level += 1
            at = at.parent


def density(node: Node) -> float:
    return min(1.0, node.linked / node.length) if node.length else 0.0


def is_link_list(node: Node) -> bool:
    """A part of a kept container that does little but link elsewhere."""
    return node.tag in CONTAINERS and node.links >= 3 and density(node) > 0.6


def drop_forms(tree: Tree) -> bool:
    """Drop the forms that are no containers; true if there were any."""
    if not any(n.tag == "form" and not n.dropped for n in tree.order):
        return False
    path = main_node(tree)[1]
    for node in reversed(tree.order):
        if node.parent is not None:
            node.parent.controls += node.controls
            node.parent.holds_main |= not node.dropped and (node.holds_main or node.tag in ("article", "main"))
    found = False
    for node in tree.order:  # parents come before their children
        if node.parent is not None and node.parent.dropped and not node.dropped:
            node.dropped = True
        elif node.tag == "form" and not node.dropped and node not in path and not node.holds_main and 0 < node.controls >= node.score:
            node.dropped = found = True
    return found


def value(node: Node) -> float:
    return node.score * (1 - density(node)) * (1.5 if node.tag in ("article", "main") else 1)


def main_node(tree: Tree) -> tuple[Node | None, set[Node]]:
    """The best container, or the article around it, and the nodes around the best container."""
    candidates = [n for n in tree.order if not n.dropped and n.tag in CONTAINERS and n.score > 0]
    if not candidates:
        return None, set()
    best = max(candidates, key=lambda n: (value(n), -n.depth))
    path, outer, at = [], best, best
    while at is not None:
        path.append(at)
        if at.tag in ("article", "main"):
            outer = at
        at = at.parent
    return outer, set(path)


def is_sentence(text: str) -> bool:
    return bool(SENTENCE.search(text))


def has_prose(node: Node, close: bool) -> bool:
    """Whether a container holds a paragraph that reads like text of the article."""
    todo = [node]
    while todo:
        at = todo.pop()
        if at.dropped or is_link_list(at):
            continue
        if at.tag == "h1":
            return True
        text = " ".join(own_text(at).split())
        share = at.linked / at.length if at.length else 0.0
        if at.tag in EXPLICIT and text and (close or share == 0 and is_sentence(text)):
            return True
        if len(text) >= LONG and share < 0.25 or close and at.tag in BLOCKS and text and share == 0 and is_sentence(text):
            return True
        todo.extend(c for c in at.children if isinstance(c, Node))
    return False


def belongs(node: Node | str, best: float, close: bool) -> bool:
    """Whether what stands beside the kept container, or beside an element around it, is part of the text."""
    if isinstance(node, str):
        text = node.strip()
        return close or len(text) >= LONG or is_sentence(text)
    if node.dropped:
        return False
    if node.tag not in BLOCKS:
        return close or node.tag != "a"
    if is_link_list(node) or not close and density(node) > 0.5:
        return False
    if node.tag in HEADINGS or close and node.tag not in CONTAINERS:
        return True
    return value(node) >= SHARE * best or has_prose(node, close)


def left_out(outer: Node, best: float) -> tuple[set[Node], set[tuple[Node, int]]]:
    """The nodes beside the kept container and beside those around it that are no part of the text, and the bare texts (by their place)."""
    nodes, texts = set(), set()
    at = outer
    while at.parent is not None:
        around = at.parent
        close = at is outer and outer.tag not in ("article", "main") and around.tag not in ("body", "html")
        for i, child in enumerate(around.children):
            if child is not at and not belongs(child, best, close):
                texts.add((around, i)) if isinstance(child, str) else nodes.add(child)
        at = around
    return nodes, texts


def blocks(top: Node, path: set[Node], out_nodes: set[Node], out_texts: set[tuple[Node, int]], links_stay: frozenset[str] | None = frozenset()) -> list[str]:
    """Runs of inline text between block borders; lists of links go unless their tags are among ``links_stay`` (None: all stay)."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo = [(top, iter(enumerate(top.children)))]
    while todo:
        at, children = todo[-1]
        i, child = next(children, (0, None))
        if child is None:
            todo.pop()
            if at.tag in BLOCKS:
                flush()
        elif isinstance(child, str):
            if (at, i) not in out_texts:
                run.append(child)
        elif child.dropped or child in out_nodes or links_stay is not None and child.tag not in links_stay and child not in path and is_link_list(child):
            if child.tag in BLOCKS or child.tag in DROPPED:
                flush()
        else:
            if child.tag in BLOCKS:
                flush()
            todo.append((child, iter(enumerate(child.children))))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    measure(tree.order)
    if drop_forms(tree):
        measure(tree.order)
    outer, path = main_node(tree)
    if outer is None:
        return "\n\n".join(blocks(tree.root, path, set(), set()))
    best = max(value(n) for n in path)
    return "\n\n".join(blocks(tree.root, path, *left_out(outer, best), None if outer.tag in ("article", "main") else frozenset() if outer.tag in FRAMES else LISTS))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [main_text(h) for h in pdf["html"]]})

    rows = pages.select(field("page_id").cast("bigint").alias("page_id"), field("url").cast("string").alias("url"),
                        F.coalesce(field("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id bigint, url string, text string")

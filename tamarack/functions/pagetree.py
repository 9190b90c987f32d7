"""Pages as trees: the article's body by scored paragraphs, header titles and code, one parse a page over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Elements without an end tag, without visible text, and parts of a page that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head".split())
ASIDE = frozenset("nav footer aside form header".split())
#: Elements that are a line of their own; of these, the ones that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table td th tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr"}
#: An open element of the first kind ends where one of the second starts, up to an element of the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements that count as a paragraph; so does a `div` or `section` without a block in it.
PARAGRAPHS = frozenset("p pre td blockquote".split())
LEAST_CHARS = 25


@dataclass
class Node:
    """An element: its parent's number, its class, its stretch of the page's pieces of text, and a frame's document and address."""

    tag: str
    parent: int
    css: str
    first: int
    last: int = 0
    blocks: bool = False  # has a block below it
    children: list[int] = field(default_factory=list)
    frame: tuple[str, str] = ("", "")


class Tree(HTMLParser):
    """Elements in document order; text of hidden elements is left out. Missing and stray end tags are taken as browsers do."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1, "", 0)]
        self.pieces: list[str] = []
        self.open = [0]
        self.feed(html)
        self.close()
        while self.open:
            self._end()

    def _end(self) -> None:
        self.nodes[self.open.pop()].last = len(self.pieces)

    def _end_until(self, tags: set[str], walls: set[str]) -> None:
        """Ends the outermost open element of these tags that no wall hides, and all in it."""
        at = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[i]].tag
            if tag in walls:
                break
            if tag in tags:
                at = i
        while at is not None and len(self.open) > at:
            self._end()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._end_until({"p"}, {"table", "td", "th", "div", "article", "section", "blockquote", "li"})
        if tag in IMPLIED:
            self._end_until(*IMPLIED[tag])
        if tag in BLOCKS:
            for i in self.open:
                self.nodes[i].blocks = True
        if tag == "br":
            self.pieces.append("\n")
        if tag in VOID:
            return
        css = next((v or "" for k, v in attrs if k == "class"), "")
        self.nodes[self.open[-1]].children.append(len(self.nodes))
        self.nodes.append(Node(tag, self.open[-1], css.lower(), len(self.pieces)))
        self.open.append(len(self.nodes) - 1)
        if tag == "body":
            self.nodes[-1].blocks = True
        if tag == "iframe":
            held = dict(attrs)
            self.nodes[-1].frame = (held.get("srcdoc") or "", held.get("src") or "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if any(self.nodes[i].tag == tag for i in self.open[1:]):
            while self.nodes[self.open[-1]].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        if not any(self.nodes[i].tag in HIDDEN for i in self.open):
            self.pieces.append(data)

    def raw(self, i: int) -> str:
        return "".join(self.pieces[self.nodes[i].first : self.nodes[i].last])

    def text(self, i: int) -> str:
        return " ".join(self.raw(i).split())

    def lines(self, i: int) -> list[str]:
        """The element's text, a line a block; a table's rows are lines of cells with tabs between them."""
        out: list[str] = []
        held: list[str] = []

        def flush() -> None:
            line = " ".join("".join(held).split())
            held.clear()
            if line:
                out.append(line)

        stack: list[tuple[int, int, int]] = [(i, self.nodes[i].first, 0)]  # element, next piece, next child
        while stack:
            n, piece, child = stack.pop()
            node = self.nodes[n]
            if child < len(node.children):
                c = node.children[child]
                held += self.pieces[piece : self.nodes[c].first]
                stack.append((n, self.nodes[c].last, child + 1))
                if self.nodes[c].tag == "tr":
                    flush()
                    cells = [self.text(d) for d in self.nodes[c].children if self.nodes[d].tag in ("td", "th")]
                    if any(cells):
                        out.append("\t".join(cells))
                    continue
                if self.nodes[c].tag in BLOCKS:
                    flush()
                stack.append((c, self.nodes[c].first, 0))
            else:
                held += self.pieces[piece : node.last]
                if node.tag in BLOCKS:
                    flush()
        flush()
        return out


def kept_blocks(tree: Tree) -> list[tuple[str, str]]:
    """(kind, text) in the order in which elements end: headings, paragraphs, code and list items, and table rows with tabs
    between their cells. Navigation is left out. A frame's own document (srcdoc) is read in its place, one from elsewhere is
    its address. Repeated headings, paragraphs and code count once, rows and list items each time."""
    found: list[tuple[str, str]] = []
    stack = [(0, False)]
    while stack:
        i, done = stack.pop()
        node = tree.nodes[i]
        if not done:
            if node.tag in ("nav", "script", "style"):
                continue
            stack.append((i, True))
            stack += [(c, False) for c in reversed(node.children)]
        elif node.tag == "tr":
            found.append(("row", "\t".join(tree.text(c) for c in node.children if tree.nodes[c].tag in ("td", "th"))))
        elif node.tag == "iframe" and any(node.frame):
            found += kept_blocks(Tree(node.frame[0])) if node.frame[0] else [("iframe", node.frame[1])]
        elif node.tag in ("p", "code", "h1", "h2", "h3", "li") or node.tag in ("td", "th") and tree.nodes[node.parent].tag != "tr":
            if text := tree.text(i):
                found.append((node.tag, text))
    seen: set[tuple[str, str]] = set()
    return [b for b in found if b[0] in ("row", "li") or b not in seen and not seen.add(b)]


def points(text: str) -> float:
    """A paragraph's points: one, one a comma, and one for each hundred characters up to three; none for short ones."""
    return 0.0 if len(text) < LEAST_CHARS else 1.0 + text.count(",") + min(len(text) // 100, 3)


def scores(tree: Tree) -> dict[int, float]:
    """The score of every element that has a paragraph as child (whole points) or grandchild (half of them), times the
    share of its text that isn't in links. Paragraphs in navigation, forms and the like give none. One pass over the nodes."""
    n = len(tree.nodes)
    outside, linked, total, sums = [False] * n, [0] * n, [0] * (len(tree.pieces) + 1), {}
    link = [0] * len(tree.pieces)
    for i, node in enumerate(tree.nodes):  # parents come before children
        outside[i] = node.parent >= 0 and (outside[node.parent] or node.tag in ASIDE)
        if node.tag == "a":
            link[node.first : node.last] = [1] * (node.last - node.first)
    sizes = [len("".join(p.split())) for p in tree.pieces]
    linked = [0] * (len(tree.pieces) + 1)
    for i, s in enumerate(sizes):
        total[i + 1], linked[i + 1] = total[i] + s, linked[i] + s * link[i]
    for i, node in enumerate(tree.nodes):
        if not outside[i] and (node.tag in PARAGRAPHS or (node.tag in ("div", "section") and not node.blocks)):
            got = points(tree.text(i))
            if got and node.parent >= 0:
                sums[node.parent] = sums.get(node.parent, 0.0) + got
                up = tree.nodes[node.parent].parent
                if up >= 0:
                    sums[up] = sums.get(up, 0.0) + got / 2
    out = {}
    for i, s in sums.items():
        node = tree.nodes[i]
        all_, in_links = total[node.last] - total[node.first], linked[node.last] - linked[node.first]
        out[i] = s * (1 - (in_links / all_ if all_ else 0.0))
    return out


def article(tree: Tree) -> tuple[str, float, list[str]]:
    """(tag, score, lines) of the page's body: the element with the highest score (the first of equals), and its siblings
    that have at least a fifth of it. A page without a scored paragraph gives its first `article`, else `main`, else `body`
    element, else all of it, with score 0."""
    found = scores(tree)
    if not found:
        at = next((i for tag in ("article", "main", "body") for i, n in enumerate(tree.nodes) if n.tag == tag), 0)
        return tree.nodes[at].tag, 0.0, tree.lines(at)
    best = min(found, key=lambda i: (-found[i], i))
    parent = tree.nodes[best].parent
    near = tree.nodes[parent].children if parent >= 0 else [best]
    lines = [line for i in near if i == best or found.get(i, 0.0) >= 0.2 * found[best] for line in tree.lines(i)]
    return tree.nodes[best].tag, found[best], lines


def header_titles(tree: Tree) -> list[str]:
    """Texts of h1, h2 and h3 elements in order, then of other elements with `header` in their class, each text once."""
    heads = [i for i, n in enumerate(tree.nodes) if n.tag in ("h1", "h2", "h3")]
    css = [i for i, n in enumerate(tree.nodes) if "header" in n.css]
    return [t for t in dict.fromkeys(tree.text(i) for i in heads + css) if t]


def code_texts(tree: Tree) -> list[str]:
    """The text of each `code` element, blanks at its ends off."""
    return [tree.raw(i).strip() for i, n in enumerate(tree.nodes) if n.tag == "code"]


#: Pages and bytes of them that are read before their results are sent on; a longer page is a lot of its own.
LOT, LOT_BYTES = 256, 4 << 20


def lots(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most LOT rows and about LOT_BYTES of a string column."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first == LOT or held + n > LOT_BYTES):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


PAGE = "tag string, score double, body string, titles array<string>, codes array<string>"


def read_pages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, tag, score, body, titles, codes) of every page from one parse. A null page is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in lots(whole, 1)):
            rows = []
            for page in b.column(1):
                tree = Tree(page.as_py() or "")
                tag, score, lines = article(tree)
                rows.append((tag, round(score, 6), "\n".join(lines), header_titles(tree), code_texts(tree)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = (pa.string(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [key, "tag", "score", "body", "titles", "codes"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, {PAGE}")

"""HTML extraction: a tree builder with implied tags, and a renderer that lays out what a reader would see.

The builder knows void and raw-text elements, closes elements that others imply (a second <p>, <li>, <tr>, <td>, <option> ...) and
ignores stray end tags. The renderer drops what is not shown (head, script, style, template, hidden, aria-hidden, display:none,
visibility:hidden, input type=hidden ...), sets blocks apart by line breaks and paragraphs by blank lines, numbers and indents lists, keeps
the spaces of <pre>, and pads table cells so that columns align.

Edge cases: null or blank html gives an empty text. Unclosed, overlapping or unknown tags never fail; a lone "<" is text. Bad
character references stay as they are. Repeated rows are rendered each. Other columns are carried; text and n_blocks are
replaced. Nesting may have any depth: no step recurses.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultline.llm.common import pieces
from faultline.session import ship_package

# Element kinds as the HTML standard has them (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title object audio video canvas svg math datalist param source track area".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option section summary ul table caption thead tbody tfoot tr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 pre hr blockquote ul ol dl table figure".split())
#: A start tag closes these open elements, up to the barrier elements.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("td", "th", "tr"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), "thead": ("tbody", "thead", "tfoot", "caption", "colgroup"), "tfoot": ("td", "th", "tr", "tbody", "thead", "caption", "colgroup"),
    "body": ("head",), "rt": ("rt", "rp"), "rp": ("rt", "rp"),
}
BARRIER = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}
TABLE_PARTS = frozenset("tr td th tbody thead tfoot".split())
ENDS_P = BLOCK - frozenset("li dd dt html body option optgroup caption thead tbody tfoot tr legend summary".split()) | SPACED

_TAG = regex.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", regex.S)
_HIDING = regex.compile(r"(?i)hidden|display|visibility|type")
_ATTRIBUTE = regex.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_STYLE = regex.compile(r"(?i)(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))")
_SPACE = regex.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "children", "hidden", "start")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1):
        self.tag, self.hidden, self.start = tag, hidden, start
        self.children: list[Node | str] = []


def _attributes(source: str) -> dict[str, str]:
    return {name.lower(): a or b or c or "" for name, a, b, c in reversed(_ATTRIBUTE.findall(source))}


def _hidden(tag: str, source: str) -> bool:
    if tag in UNSEEN:
        return True
    if not source or not _HIDING.search(source):
        return False
    found = _attributes(source)
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or tag == "dialog" and "open" not in found or bool(_STYLE.search(found.get("style", ""))) or tag == "input" and found.get("type", "").lower() == "hidden"


def tree(html: str) -> Node:
    root = Node("")
    stack = [root]

    def close(tags: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        """Close the open elements of these names that stand above the next barrier."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in barrier:
                return
            if stack[k].tag in tags:
                lowest = k
                while lowest > 1 and stack[lowest - 1].tag in tags and stack[lowest - 1].tag not in barrier:
                    lowest -= 1
                del stack[lowest:]
                return

    at, size = 0, len(html)
    while at < size:
        found = _TAG.search(html, at)
        if found is None:
            stack[-1].children.append(html[at:])
            break
        if found.start() > at:
            stack[-1].children.append(html[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag = name.lower()
        if found[1]:
            if tag == "p" and all(n.tag != "p" for n in stack[1:]):
                stack[-1].children.append(Node("p"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "td", "th") and tag not in ("table", *TABLE_PARTS):
                    break  # an end tag inside a cell closes nothing outside it
            continue
        if tag in CLOSES:
            close(CLOSES[tag], BARRIER.get(tag, ("table",)))
        if tag in ENDS_P:
            close(("p",), ("table", "td", "th", "li", "dd", "dt", "button", "caption"))
        source = found[3]
        start = 1
        if tag == "ol" and source:
            value = _attributes(source).get("start", "1")
            start = int(value) if regex.fullmatch(r"-?\d{1,9}", value) else 1
        node = Node(tag, _hidden(tag, source), start)
        if tag == "dialog" and not source:
            node.hidden = True
        stack[-1].children.append(node)
        if tag in VOID or (source.endswith("/") and tag in ("svg", "math", "path")):
            continue
        if tag in RAW:
            end = regex.compile(rf"(?i)</{regex.escape(tag)}[\s/>]").search(html, at)
            stop = end.start() if end else size
            node.children.append(html[at:stop])
            at = stop
            if end:
                at = html.find(">", stop) + 1 or size
            continue
        stack.append(node)
    return root


class _Out:
    """Lines with pending line breaks; spaces fold across inline elements."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.blocks = 0, False, 0
        self.prefix = ""  # of the next line, once (a bullet)
        self.indent = ""

    def rest(self, breaks: int) -> None:
        self.breaks, self.space = max(self.breaks, breaks), False

    def _open(self) -> None:
        if self.breaks or not self.parts:
            if self.parts:
                self.parts.append("\n" * self.breaks)
            self.parts.append(self.indent + self.prefix)
            self.indent += " " * len(self.prefix)
            self.blocks += 1
            self.breaks, self.prefix, self.space = 0, "", False

    def text(self, value: str) -> None:
        value = _SPACE.sub(" ", unescape(value) if "&" in value else value)
        body = value.strip(" ")
        if not body:
            self.space = True
            return
        opened = self.breaks or not self.parts
        self._open()
        if not opened and (self.space or value[0] == " "):
            self.parts.append(" ")
        self.parts.append(body)
        self.space = value[-1] == " "

    def raw(self, value: str) -> None:
        value = unescape(value).removeprefix("\n").rstrip()
        if value:
            self._open()
            self.parts.append(value.replace("\n", "\n" + self.indent))

    def done(self) -> str:
        return "".join(self.parts)


def _cells(node: Node) -> list[list[Node]]:
    """The shown rows of a table as lists of their cells."""
    rows, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str) or child.hidden or child.tag == "caption":
            continue
        if child.tag == "tr":
            rows.append([c for c in child.children if isinstance(c, Node) and not c.hidden])
        elif child.tag in ("td", "th"):
            rows.append([child])
        elif child.tag != "table":
            todo.extend(reversed(child.children))
    return rows


def _simple(node: Node) -> bool:
    """Whether no cell holds a table or a block, so that rows can be single lines."""
    todo = [c for row in _cells(node) for cell in row for c in cell.children]
    while todo:
        child = todo.pop()
        if isinstance(child, Node) and not child.hidden:
            if child.tag in BLOCK or child.tag in SPACED and child.tag != "p" or child.tag == "br":
                return False
            todo.extend(child.children)
    return True


def _line(node: Node) -> str:
    out = _Out()
    _render(node, out)
    return " ".join(out.done().split())


def _table(node: Node, out: _Out) -> None:
    grid = [[_line(cell) for cell in row] for row in _cells(node)]
    widths = [max((len(row[k]) for row in grid if k < len(row)), default=0) for k in range(max(map(len, grid), default=0))]
    for row in grid:
        line = " | ".join(cell.ljust(width) for cell, width in zip(row, widths)).rstrip()
        if line.strip(" |"):
            out.rest(1)
            out._open()
            out.parts.append(line)
    out.rest(1)


def _render(root: Node, out: _Out) -> None:
    # What is left to do: nodes and texts with their surroundings, or functions that restore them.
    todo: list = [(child, False, None) for child in reversed(root.children)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        child, pre, numbers = item
        if isinstance(child, str):
            (out.raw if pre else out.text)(child)
            continue
        if child.hidden:
            continue
        tag = child.tag
        if tag == "br":
            if out.breaks or not out.parts:
                out.rest(min(out.breaks + 1, 2))
            else:
                out.rest(1)
            continue
        if tag == "hr":
            out.rest(2)
            continue
        if tag == "table" and _simple(child):
            out.rest(2)
            captions = [c for c in child.children if isinstance(c, Node) and c.tag == "caption" and not c.hidden]
            for caption in captions:
                line = _line(caption)
                if line:
                    out.text(line)
                    out.rest(1)
            _table(child, out)
            out.rest(2)
            continue
        if tag in ("td", "th"):
            out.rest(1) if not _inline_only(child) else out.text(" ")
        gap = 2 if tag in SPACED else 1 if tag in BLOCK else 0
        if tag in ("ul", "ol", "menu", "dir") and numbers is not None:
            gap = 1  # lists inside lists stay close
        if gap:
            out.rest(gap)
        if tag in ("ul", "menu", "dir"):
            numbers = []
        elif tag == "ol":
            numbers = [child.start]
        restore = None
        if tag == "li":
            before = out.indent
            bullet = "- "
            if numbers:
                bullet = f"{numbers[0]}. "
                numbers[0] += 1
            out.prefix = bullet

            def restore(before: str = before) -> None:
                out.indent, out.prefix = before, ""
                out.rest(1)
        elif tag in ("blockquote", "dd"):
            before = out.indent
            out.indent += "  "

            def restore(before: str = before, gap: int = gap) -> None:
                out.indent = before
                out.rest(gap)
        elif gap:

            def restore(gap: int = gap) -> None:
                out.rest(gap)

        if restore:
            todo.append(restore)
        inner = pre or tag in ("pre", "textarea", "xmp", "listing")
        todo.extend((c, inner, numbers) for c in reversed(child.children))


def _inline_only(node: Node) -> bool:
    return all(isinstance(c, str) or c.tag not in BLOCK and c.tag not in SPACED for c in node.children)


def rendered(html: str | None) -> tuple[str, int]:
    """(text, number of blocks)."""
    if not html:
        return "", 0
    out = _Out()
    _render(tree(html), out)
    return out.done(), out.blocks


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and n_blocks."""
    ship_package(pages.sparkSession)
    carried = [c for c in pages.columns if c not in ("text", "n_blocks")]
    schema = T.StructType([*(pages.schema[c] for c in carried), T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, html):
            done = [rendered(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=[*carried, "text", "n_blocks"])

    return pages.select(*carried).mapInArrow(read, schema)

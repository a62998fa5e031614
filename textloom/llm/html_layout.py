"""Layout-aware rendering of HTML to text.

A tokeniser and tree builder with implied tags (a paragraph ends where a block
begins, items end items, cells end cells, and so on) feed a renderer that emits
all visible text. Blocks stand on lines of their own, paragraphs and headings
between empty lines; list items are indented and marked with a dash or number;
preformatted text keeps its spaces; table cells are padded to the width of
their column, spans included. Cells wrap at ``WRAP`` characters, between words;
a longer word stands out of its column and pads no other row. Spans are as
HTML limits them: 1,000 columns, 65,534 rows.

Invisible are scripts, styles, templates, the head, elements that are hidden by
attribute or by an inline ``display: none``, closed dialogs, all of closed details but
the summary, and hidden inputs; ``visibility: hidden`` hides until a descendant
is made visible again.

Defined results: null and empty pages give an empty text; damaged markup never
fails: what isn't a tag is text, unknown elements are inline, end tags without
start are ignored, elements may be nested to any depth; pages are read whole;
repeated rows give repeated results; an empty table gives an empty table. Only
the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "  "
WRAP = 80
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534
#: Characters of rendered pages that are held before they are passed on.
HELD_CHARS = 8 << 20

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ONLY = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base col colgroup param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr listing xmp".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog div dd dt fieldset figcaption footer form header hgroup legend li main nav optgroup option search section summary tr td th thead tbody tfoot caption".split())
ENDS_P = BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup legend".split())
#: Elements that an open head or column group holds; any other, and text, ends it.
HOLDS = {
    "head": frozenset("base basefont bgsound link meta title style script noscript noframes template".split()),
    "colgroup": frozenset("col template".split()),
}
ROW_GROUPS = frozenset("thead tbody tfoot".split())
#: What a start tag closes, and at which elements the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption html body".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)  # nodes and strings


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


class Markup:
    """The tags of a page, found in one pass: a closing bracket inside quotes ends no tag, unless quotes aren't closed.

    Where the scan from one mark leads is remembered, so that pages of unclosed
    tags and quotes cost no more than others; behind the last closing bracket
    there are no tags.
    """

    def __init__(self, html: str) -> None:
        self.html, self.last = html, html.rfind(">")
        self.ends: dict[int, int] = {}

    def end(self, at: int) -> int:
        """Place of the first closing bracket outside quotes from ``at`` on; -1 without one."""
        path, found = [], -1
        while (m := _MARK.search(self.html, at)) is not None:
            q = m.start()
            if q in self.ends:
                found = self.ends[q]
                break
            path.append(q)
            if m[0] == ">":
                found = q
                break
            close = self.html.find(m[0], q + 1)
            if close < 0:
                break
            at = close + 1
        for q in path:
            self.ends[q] = found
        return found

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        """(start, end, slash, name, rest) of the next markup; comments and the like have no name."""
        html = self.html
        while True:
            start = html.find("<", at)
            if start < 0:
                return None
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", None, ""
            if start > self.last:
                at = html.find("<!--", start)
                if at < 0:
                    return None
                continue
            m = _NAME.match(html, start + 1)
            if m:
                end = self.end(m.end())
                if end < 0:
                    end = html.find(">", m.end())
                return start, end + 1, m[1], m[2], html[m.end() : end]
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                return start, html.find(">", start + 2) + 1, "", None, ""
            at = start + 1

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """Where the end tag of a raw element begins and ends; the end of the page without one."""
        n = len(self.html)
        if at <= self.last:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.html, at)
            if m and m.start() < self.last:
                return m.start(), self.html.find(">", m.end()) + 1
        return n, n


def parse(html: str) -> Node:
    """The tree of a page."""
    markup = Markup(html)
    root = Node("html", {})
    stack = [root]
    is_open = Counter()  # elements of each name on the stack

    def push(node: Node) -> None:
        stack.append(node)
        is_open[node.tag] += 1

    def pop() -> None:
        is_open[stack.pop().tag] -= 1

    def close(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> bool:
        if not any(is_open[t] for t in tags):
            return False
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    pop()
                return True
            if stack[k].tag in stops:
                return False
        return False

    def text(start: int, end: int) -> None:
        if end > start:
            part = html[start:end]
            if stack[-1].tag in HOLDS and part.strip(" \t\n\r\f"):
                pop()
            stack[-1].children.append(unescape(part) if "&" in part else part)

    at, n = 0, len(html)
    while at < n:
        found = markup.next(at)
        if found is None:
            text(at, n)
            break
        start, end, slash, name, raw = found
        text(at, start)
        at = end
        if name is None:
            continue  # comment, doctype or stray markup
        tag = name.lower()
        if slash:
            if tag == "p" and not is_open["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag not in VOID and tag not in ("html", "body"):
                close({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
            continue
        if tag in ("html", "body") and tag == "html":
            root.attributes.update(_attributes(raw))
            continue
        if stack[-1].tag in HOLDS and tag not in HOLDS[stack[-1].tag]:
            pop()
        if tag in ENDS_P:
            close({"p"}, SCOPE | {"button"})
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            while close(ends, stops):
                pass
        if tag in ("td", "th") and (stack[-1].tag == "table" or stack[-1].tag in ROW_GROUPS):
            stack[-1].children.append(Node("tr", {}))
            push(stack[-1].children[-1])
        if len(tag) == 2 and tag[0] == "h" and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            pop()
        node = Node(tag, _attributes(raw))
        stack[-1].children.append(node)
        if tag in RAW or tag in TEXT_ONLY:
            stop, after = markup.raw_end(tag, at)
            if tag in TEXT_ONLY:
                node.children.append(unescape(html[at:stop]))
            elif tag == "xmp":
                node.children.append(html[at:stop])
            at = after
        elif tag not in VOID:
            push(node)
    return root


def _visible(node: Node, shown: bool) -> tuple[bool, bool]:
    """Whether the element takes part at all, and whether its own text is shown."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, False
    style = a.get("style")
    if style:
        if _HIDDEN.search(style):
            return False, False
        if m := _VISIBILITY.search(style):
            shown = m[1].lower() not in ("hidden", "collapse")
    return True, shown


class _Writer:
    """Collects lines; spaces collapse, block borders become line ends or empty lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0  # empty lines due before the next text
        self.prefix: list[str] = []  # of lines inside lists and quotations
        self.mark: str | None = None  # of the item whose first line is to come

    def text(self, s: str) -> None:
        flat = _SPACES.sub(" ", s)
        if flat == " " or not flat:
            self.space = self.space or bool(flat)
            return
        if self.line and (self.space or flat[0] == " "):
            self.line.append(" ")
        self.line.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def end(self) -> None:
        """End the line, if it has text."""
        if self.line:
            self.put("".join(self.line))
        self.line, self.space = [], False

    def put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        lead = "".join(self.prefix)
        if self.mark is not None:
            lead = "".join(self.prefix[:-1]) + self.mark
            self.mark = None
        self.lines.append((lead + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced and self.lines:
            self.gap = 1


def _children(node: Node) -> list:
    if node.tag == "details" and "open" not in node.attributes:
        return [x for x in node.children if isinstance(x, Node) and x.tag == "summary"]
    return node.children


#: Rendering of an element, which yields those of elements inside it; ``_run`` takes them one by one, to any depth.
Steps = Generator["Steps", None, None]


def _run(steps: Steps) -> None:
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _render(node: Node, out: _Writer, shown: bool, pre: bool) -> Steps:
    for child in _children(node):
        if isinstance(child, str):
            if not shown:
                continue
            if pre:
                for k, line in enumerate(child.split("\n")):
                    if k:
                        out.put("".join(out.line))
                        out.line = []
                    if line:
                        out.line.append(line.rstrip("\r"))
            else:
                out.text(child)
            continue
        take, seen = _visible(child, shown)
        if not take:
            continue
        tag = child.tag
        if tag == "br":
            if out.line:
                out.end()
            elif out.lines and seen and not out.gap:
                out.gap = 1
        elif tag == "table":
            yield _table(child, out, seen)
        elif tag in ("ul", "ol", "menu", "dir"):
            yield _list(child, out, seen, pre)
        elif tag == "input":
            if seen and child.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                out.text(" " + child.attributes.get("value", "") + " ")
        elif tag in ("pre", "textarea", "xmp"):
            out.block(tag != "textarea")
            if tag != "xmp" and child.children and isinstance(child.children[0], str) and child.children[0].startswith("\n"):
                child.children[0] = child.children[0][1:]
            yield _render(child, out, seen, True)
            out.block(tag != "textarea")
        elif tag == "blockquote" or tag == "dd":
            out.block(tag in SPACED)
            out.prefix.append(GAP)
            yield _render(child, out, seen, pre)
            out.block(tag in SPACED)
            out.prefix.pop()
        elif tag in BLOCK:
            out.block(tag in SPACED)
            yield _render(child, out, seen, pre)
            out.block(tag in SPACED)
        else:
            yield _render(child, out, seen, pre)


def _whole(value: str | None, default: int, most: int = 10**6) -> int:
    try:
        return max(-most, min(most, int(value)))
    except (TypeError, ValueError):
        return default


def _list(node: Node, out: _Writer, shown: bool, pre: bool) -> Steps:
    inside = bool(out.prefix)
    out.block(not inside)
    number = _whole(node.attributes.get("start"), 1)
    for child in _children(node):
        if isinstance(child, str):
            if shown:
                out.text(child)
            continue
        take, seen = _visible(child, shown)
        if not take:
            continue
        if child.tag == "li":
            number = _whole(child.attributes.get("value"), number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            out.end()
            out.prefix.append(" " * len(mark))
            held, out.mark = out.mark, mark
            yield _render(child, out, seen, pre)
            out.end()
            out.mark = held if out.mark is not None else None
            out.prefix.pop()
        else:
            holder = Node("div", {}, [child])
            yield _render(holder, out, seen, pre)
    out.block(not inside)


def _rows(node: Node, shown: bool) -> Iterator[tuple[Node, bool]]:
    for child in node.children:
        if isinstance(child, Node):
            take, seen = _visible(child, shown)
            if take and child.tag == "tr":
                yield child, seen
            elif take and child.tag in ROW_GROUPS:
                yield from _rows(child, seen)


def _strays(node: Node, shown: bool) -> Iterator[tuple[list, bool]]:
    """Runs of what stands in a table, or in its row groups, outside rows."""
    held: list = []
    for child in node.children:
        if isinstance(child, str) or (child.tag != "tr" and child.tag not in ROW_GROUPS):
            held.append(child)
        elif child.tag in ROW_GROUPS:
            take, seen = _visible(child, shown)
            if take:
                yield held, shown
                held = []
                yield from _strays(child, seen)
    yield held, shown


def _wrapped(lines: list[str]) -> list[str]:
    """Lines of at most ``WRAP`` characters, cut between words; preformatted and short ones stay as they are."""
    out: list[str] = []
    for line in lines:
        while len(line) > WRAP:
            at = line.rfind(" ", 1, WRAP + 1)
            if at < 0 or not line[:at].strip():
                at = line.find(" ", WRAP)
                if at < 0:
                    break
            out.append(line[:at].rstrip())
            line = line[at + 1 :].lstrip()
        out.append(line)
    return out


class _Held:
    """Columns that cells of rows above still hold: (first, behind the last, rows left)."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []

    def next_row(self) -> None:
        self.spans = [(a, b, n - 1) for a, b, n in self.spans if n > 1]

    def free(self, column: int) -> int:
        """The first free column from here; spans are in order and don't overlap much."""
        for a, b, _ in self.spans[bisect_left(self.spans, (column - MAX_COLSPAN,)) :]:
            if a > column:
                break
            column = max(column, b)
        return column


Cells = list[tuple[int, int, list[str]]]  # column, span and lines of the cells of a row


def _table(node: Node, out: _Writer, shown: bool) -> Steps:
    out.block(True)
    for stray, seen in _strays(node, shown):
        if stray:
            yield _render(Node("div", {}, stray), out, seen, False)
            out.end()
    grid: list[Cells] = []
    held = _Held()
    for row, seen in _rows(node, shown):
        cells: Cells = []
        column, longer = 0, []
        for cell in row.children:
            if isinstance(cell, str):
                cell = Node("td", {}, [cell]) if cell.strip() else None
            if cell is None:
                continue
            take, own = _visible(cell, seen)
            if not take:
                continue
            column = held.free(column)
            wide = min(MAX_COLSPAN, max(1, _whole(cell.attributes.get("colspan"), 1)))
            deep = min(MAX_ROWSPAN, max(1, _whole(cell.attributes.get("rowspan"), 1)))
            w = _Writer()
            yield _render(cell if cell.tag in ("td", "th") else Node("td", {}, [cell]), w, own, False)
            w.end()
            cells.append((column, wide, _wrapped(w.lines)))
            if deep > 1:
                longer.append((column, column + wide, deep))
            column += wide
        held.next_row()
        held.spans = sorted(held.spans + [(a, b, n - 1) for a, b, n in longer])
        if any(lines for _, _, lines in cells):
            grid.append(cells)
    _lay_out(grid, out)
    out.block(True)


def _lay_out(grid: list[Cells], out: _Writer) -> None:
    """Lines of a table: columns in which a cell starts are as wide as their widest line of one column."""
    columns = sorted({c for cells in grid for c, _, _ in cells})
    widths = dict.fromkeys(columns, 0)
    for cells in grid:
        for c, wide, lines in cells:
            if wide == 1:
                widths[c] = max(widths[c], max((len(x) for x in lines if len(x) <= WRAP), default=0))
    left = [0]  # where the text of each column begins
    for c in columns:
        left.append(left[-1] + widths[c] + len(GAP))
    for cells in grid:
        for k in range(max(len(lines) for _, _, lines in cells)):
            line: list[str] = []
            at = 0
            for c, _, lines in cells:
                if k < len(lines) and lines[k]:
                    start = left[bisect_left(columns, c)]
                    lead = max(start - at, len(GAP) if line else 0)
                    line.append(" " * lead + lines[k])
                    at += lead + len(lines[k])
            out.put("".join(line))


def render(html: str | None) -> str:
    """The visible text of a page, laid out."""
    if not html:
        return ""
    out = _Writer()
    root = parse(html)
    take, shown = _visible(root, True)
    if take:
        _run(_render(root, out, shown, False))
    out.end()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return "\n".join(out.lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id column, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for k, page in enumerate(batch.column(1), 1):
                held.append(render(page.as_py()))
                size += len(held[-1])
                if size >= HELD_CHARS or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(held, pa.string())], names=[id_col, "text"])
                    first, held, size = k, [], 0

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")

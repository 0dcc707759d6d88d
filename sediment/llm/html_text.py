"""HTML extraction: a tree builder with implied tags, visibility rules and a layout-aware renderer.

*Tree.* Tags are scanned without regard to validity: a start tag closes what it implies (a block an open ``p``,
``li`` a sister ``li``, ``td`` a cell, ``tr`` a row, ...), an end tag closes up to its element or is dropped,
``</br>`` is a break and ``</p>`` without a ``p`` an empty paragraph. Comments, doctypes and processing instructions
vanish; ``script``, ``style``, ``textarea`` and ``title`` are raw up to their end tag. A ``<`` that begins no tag is
text. Character references are resolved.

*Visibility.* ``head`` and what belongs there, scripts, styles, templates, embedded media, and elements with the
attribute ``hidden`` or ``display: none`` are not rendered, nor is anything inside them. ``visibility`` is inherited until
an element sets it again. Both are declared in ``style`` attributes and in the page's ``style`` elements, where rules for
tags, classes, ids and compounds of them count, by importance, specificity and order; rules that need more of the page
(descendants, states, attributes) and those of media other than screens do not. The contents of ``object`` are shown.
MathML is text but for its annotations; of ``svg`` the contents of ``text`` and ``foreignObject`` are, but for titles,
descriptions and definitions (what only ``use`` brings up is not).

*Layout.* White space collapses but for ``pre`` and ``textarea``. Blocks begin a line; paragraphs, headings,
lists, tables and quotes have a blank line about them; ``br`` breaks a line and ``hr`` draws one. List items are
marked ``- `` or numbered and indented by depth, to ``INDENT`` columns at most. Tables are grids: cells of a column are padded to one width
and parted by `` | ``, a cell over several columns or rows takes them up. A cell is one line; a table inside a cell is
in that line, with its cells parted alike.

A null or empty page gives the empty text, a page of text without tags that text; time grows with the page's length,
however deep its elements lie. Other columns are carried, a column named like an output is replaced, an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, through_python

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset(
    "head title meta link base style script noscript template iframe embed audio video canvas datalist area param source track noembed noframes col colgroup".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure fieldset".split())
#: A start tag of the first kind closes an open element of the second, unless a boundary is met first.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
}
#: Elements that keep an open p outside them open.
P_SCOPE = frozenset("button table td th caption html body object template".split())
#: Lines are indented by depth, but not further.
INDENT = 80
CELL_SCOPE = frozenset(("table",))
ROW_GROUPS = frozenset("table tbody thead tfoot".split())

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s=/>"'][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SELECTOR = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)\s*", re.I)
_PROPERTIES = ("display", "visibility")
#: Not rendered inside svg and math.
FOREIGN_HIDDEN = {
    "svg": frozenset("title desc metadata defs style script symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Elements of svg and math with HTML inside.
HTML_INSIDE = frozenset("foreignobject mi mo mn ms mtext".split())
#: Pieces of svg and math that stand apart.
APART = frozenset("text mtr mtd".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden", "visible", "space", "inside")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children = tag, attrs, []
        # Where the element itself and where its children belong: svg, math, or neither.
        self.space = tag if tag in FOREIGN_HIDDEN else parent.inside if parent else ""
        self.inside = "" if tag in HTML_INSIDE else self.space
        self.hidden = tag in HIDDEN or tag in FOREIGN_HIDDEN.get(self.space, ())
        self.visible = True


def declarations(style: str) -> dict[str, tuple[bool, str]]:
    """The properties that matter here as (important, value); of equal names the last, important ones first."""
    out: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", style).split(";") if "/*" in style else style.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in _PROPERTIES:
            value, mark, _ = value.lower().partition("!")
            important = bool(mark) and "important" in part.lower()
            if value.strip() and (important or not out.get(name, (False,))[0]):
                out[name] = (important, value.strip())
    return out


class Sheet:
    """The rules of a page's style elements that are looked up by tag, class and id."""

    def __init__(self):
        self.by: dict[str, list[tuple]] = {}
        self.count = 0

    def read(self, css: str) -> None:
        css = _COMMENT.sub(" ", css)
        at, size = 0, len(css)
        while at < size:
            brace, end = css.find("{", at), css.find(";", at)
            head = css[at : brace if brace >= 0 else size].strip()
            if head.startswith("@") and 0 <= end < (brace if brace >= 0 else size):  # a statement such as @import
                at = end + 1
                continue
            if brace < 0:
                return
            if head.startswith("}"):  # the end of a block that was entered
                head = head.lstrip("} \t\r\n\f")
            if _SCREEN.fullmatch(head):
                at = brace + 1
                continue
            if head.startswith("@"):
                at = self._past(css, brace)
                continue
            close = css.find("}", brace)
            close = size if close < 0 else close
            found = declarations(css[brace + 1 : close])
            if found:
                for selector in head.split(","):
                    self._add(selector.strip(), found)
            at = close + 1

    @staticmethod
    def _past(css: str, brace: int) -> int:
        depth, at = 1, brace + 1
        while depth:
            m = re.compile("[{}]").search(css, at)
            if not m:
                return len(css)
            depth += 1 if m.group() == "{" else -1
            at = m.end()
        return at

    def _add(self, selector: str, found: dict) -> None:
        m = _SELECTOR.fullmatch(selector)
        if not m or not selector:
            return
        tag = (m.group(1) or "*").lower()
        marks = re.findall(r"[.#][\w-]+", m.group(2))
        ids = sum(x[0] == "#" for x in marks)
        self.count += 1
        rank = (ids, len(marks) - ids, int(tag != "*"), self.count)
        self.by.setdefault(marks[0] if marks else tag, []).append((tag, frozenset(marks), rank, found))

    def styles(self, node: Node) -> dict[str, str]:
        """The winning values for an element; what it says itself is stronger than rules, and weaker than important ones."""
        own = {"." + c for c in node.attrs.get("class", "").split()} if self.by else set()
        if self.by and node.attrs.get("id"):
            own.add("#" + node.attrs["id"])
        best: dict[str, tuple] = {}
        for key in (*own, node.tag, "*") if self.by else ():
            for tag, marks, rank, found in self.by.get(key, ()):
                if tag in ("*", node.tag) and marks <= own:
                    for name, (important, value) in found.items():
                        best[name] = max(best.get(name, ()), (important, 0, rank, value))
        if "style" in node.attrs:
            for name, (important, value) in declarations(node.attrs["style"]).items():
                best[name] = max(best.get(name, ()), (important, 1, (), value))
        return {name: x[-1] for name, x in best.items()}


def styled(root: Node) -> Node:
    """Decides which elements are hidden and which are visible, and drops the text of those that are not."""
    sheet, todo = Sheet(), [root]
    while todo:
        x = todo.pop()
        if x.tag == "style" and not x.space:
            sheet.read("".join(c for c in x.children if isinstance(c, str)))
        todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
    todo = [(root, True)]
    while todo:
        x, visible = todo.pop()
        said = sheet.styles(x) if sheet.by or "style" in x.attrs else {}
        shown = said.get("display", "none" if "hidden" in x.attrs else "")
        x.hidden = x.hidden or shown == "none"
        if x.hidden:
            continue
        word = said.get("visibility", "")
        x.visible = visible if word in ("", "inherit", "unset") else word not in ("hidden", "collapse")
        if not x.visible:
            x.children = [c for c in x.children if not isinstance(c, str)]
        todo.extend((c, x.visible) for c in x.children if not isinstance(c, str))
    return root


def _tags(page: str, foreign: list[bool]) -> Iterator[tuple[str, str, dict]]:
    """("text", text, {}), ("start", name, attributes), ("end", name, {}); ``foreign`` says if svg or math is open, where
    a tag may close itself."""
    at, size = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], {}
            return
        if lt > at:
            yield "text", page[at:lt], {}
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            yield "text", "<", {}
            at = lt + 1
            continue
        name, pos, attrs, slash = m.group().lower(), m.end(), {}, -1
        while pos < size and page[pos] != ">":
            if page[pos] in "\"'":  # a stray quote, or one that never ends
                pos += 1
                continue
            a = _ATTR.match(page, pos)
            if a:
                value = a.group(2)
                if value is None:
                    attrs.setdefault(a.group(1).lower(), "")
                else:
                    attrs.setdefault(a.group(1).lower(), html.unescape(value[1:-1] if value[0] in "\"'" else value))
                pos = a.end()
                while value is None and pos < size and page[pos] in " \t\n\r\f=":  # = before a quote without end
                    pos += 1
                    if pos < size and page[pos] in "\"'" and last[page[pos]] <= pos:
                        pos = page.find(">", pos)
                        pos = size if pos < 0 else pos
                        break
            else:
                slash = pos if page[pos] == "/" else slash
                pos += 1
        at = pos + 1
        if name[0] == "/":
            yield "end", name[1:], {}
            continue
        yield "start", name, attrs
        if foreign[0] and slash >= 0 and slash == pos - 1:
            yield "end", name, {}
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else size
            yield "text", page[at:stop], {}
            yield "end", name, {}
            if end:
                gt = page.find(">", end.end())
                at = size if gt < 0 else gt + 1
            else:
                at = size


def parse(page: str) -> Node:
    """The tree of a page, under a nameless root."""
    root = Node("", {})
    stack, foreign = [root], [False]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of each tag are

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def close_to(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def nearest(names, scope) -> int:
        """The innermost open element of these names, unless a boundary lies inside it; 0 if there is none."""
        k = last(names)
        return k if k and k >= last(scope) else 0

    for what, value, attrs in _tags(page, foreign):
        if what == "text":
            if stack[-1].inside == "svg" and not places.get("text"):
                continue
            raw = stack[-1].tag in ("script", "style")
            stack[-1].children.append(value if raw else html.unescape(value))
            continue
        if what == "end":
            if value == "br":
                stack[-1].children.append(Node("br", {}))
            elif value == "p" and not nearest(("p",), P_SCOPE):
                stack[-1].children.append(Node("p", {}))
            elif places.get(value) and value not in ("body", "html"):
                scope = () if value in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") else ("table",)
                k = nearest((value,), scope)
                if k:
                    close_to(k)
            foreign[0] = stack[-1].space != ""
            continue
        while stack[-1].inside and value in BLOCKS:  # HTML ends an open svg or math
            close_to(len(stack) - 1)
        if value in BLOCKS and (k := nearest(("p",), P_SCOPE)):
            close_to(k)
        if value in CLOSES and (k := nearest(*CLOSES[value])):
            close_to(k)
        if value in ("tbody", "thead", "tfoot", "tr") and (k := nearest(("tr",), CELL_SCOPE)):
            close_to(k)
        if value in ("body", "html") and places.get(value):
            continue
        if value == "body" and (k := nearest(("head",), ())):
            close_to(k)
        elif value in BLOCKS and value != "html" and places.get("head") and (k := nearest(("head",), ())):
            close_to(k)
        if value in ("td", "th") and stack[-1].tag in ROW_GROUPS:
            row = Node("tr", {}, stack[-1])
            stack[-1].children.append(row)
            push(row)
        node = Node(value, attrs, stack[-1])
        stack[-1].children.append(node)
        if value not in VOID:
            push(node)
        foreign[0] = stack[-1].space != ""
    return styled(root)


class _Page:
    """Collects lines: collapses space, keeps pending breaks apart from text, indents list items."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks = self.space = 0
        self.fresh = True  # nothing on this line yet
        self.indent = 0
        self.marker: str | None = None
        self.bars = 0  # cells of a table inside a cell that were begun since the last text

    def block(self, lines: int) -> None:
        self.space = 0
        self.breaks = max(self.breaks, lines)

    def _begin(self) -> None:
        if self.breaks and self.out:
            self.out.append("\n" * (self.breaks - (self.fresh and self.out[-1] == "\n")))
            self.fresh = True
        self.breaks = 0
        if self.fresh:
            mark, self.marker = self.marker or "", None
            self.out.append(" " * min(self.indent - len(mark), INDENT) + mark)
            self.fresh = False
            self.space = 0
        elif self.space:
            self.out.append(" ")
            self.space = 0
        if self.bars:
            self.out.append(" | " * self.bars)
            self.bars = 0

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if not s:
            return
        body = s.strip(" ")
        if body:
            if s[0] == " ":
                self.space = 1
            self._begin()
            self.out.append(body.replace("\xa0", " "))
            self.space = int(s[-1] == " ")
        else:
            self.space = 1

    def literal(self, s: str) -> None:
        for i, line in enumerate(s.split("\n")):
            if i:
                self.newline()
            if line:
                self._begin()
                self.out.append(line)

    def newline(self) -> None:
        self.space = 0
        if self.breaks or not self.out:
            return
        self.out.append("\n")
        self.fresh = True

    def done(self) -> str:
        return "\n".join(line.rstrip() for line in "".join(self.out).split("\n")).strip("\n")


def _rows(table: Node) -> tuple[list[list[Node]], list[Node]]:
    """(rows of cells, captions); what lies in a table outside any cell is a row of its own."""
    rows: list[list[Node]] = []
    captions: list[Node] = []
    todo: list = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                loose = Node("td", {})
                loose.children.append(x)
                rows.append([loose])
        elif x.hidden:
            continue
        elif x.tag in ("tbody", "thead", "tfoot"):
            todo.extend(reversed(x.children))
        elif x.tag == "tr":
            row = []
            for c in x.children:
                if isinstance(c, str):
                    if not c.strip():
                        continue
                    cell = Node("td", {})
                    cell.children.append(c)
                    c = cell
                if not c.hidden:
                    row.append(c)
            rows.append(row)
        elif x.tag == "caption":
            captions.append(x)
        else:
            rows.append([x])
    return rows, captions


def _span(cell: Node, name: str, most: int) -> int:
    n = cell.attrs.get(name, "1").strip()
    return min(max(int(n), 0), most) if n.isascii() and n.isdigit() and len(n) < 6 else 1


def _grid(rows: list[list[Node]]) -> list[str]:
    """The lines of a table. Columns in which no cell begins take no room."""
    placed: list[list[tuple[int, int, str]]] = []  # (column, columns, text) by row
    taken: dict[int, tuple[int, int]] = {}  # a column of a cell over several rows: the row it ends before, the column after
    for r, row in enumerate(rows):
        at, line, below = 0, [], []
        for cell in row:
            while taken.get(at, (0, 0))[0] > r:
                at = taken[at][1]
            across = max(_span(cell, "colspan", 1000), 1)
            down = _span(cell, "rowspan", 65534) or len(rows)
            line.append((at, across, " ".join(render(cell, flat=True).split())))
            if down > 1:
                below.append((at, at + across, r + down))
            at += across
        for first, after, end in below:
            for k in range(first, after):
                taken[k] = (end, after)
        placed.append(line)
    columns = sorted({at for line in placed for at, _, _ in line})
    width = dict.fromkeys(columns, 0)
    for line in placed:
        for at, across, text in line:
            if across == 1:
                width[at] = max(width[at], len(text))
    before = [0]  # room of the columns so far, bars included
    for c in columns:
        before.append(before[-1] + width[c] + 3)
    lines = []
    for line in placed:
        if not any(text for *_, text in line):
            continue
        out, k = [], 0
        for at, across, text in line:
            i, j = bisect_left(columns, at), bisect_left(columns, at + across)
            if i > k:  # columns that a cell from above takes up, or that the row lacks
                out.append(" " * (before[i] - before[k] - 3))
            out.append(text.ljust(before[j] - before[i] - 3))
            k = j
        lines.append(" | ".join(out).rstrip())
    return lines


def render(root: Node, flat: bool = False) -> str:
    """The visible text of a tree; ``flat`` for a cell, in which tables are no grids."""
    page = _Page()
    counters: list[int | None] = []  # of the open lists; None for unordered ones
    cells: list[int] = []  # of the open rows of tables inside a cell
    # A node, a closing action, or text; the stack stands for recursion.
    todo: list = [root]
    pre = 0
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            page.literal(x) if pre else page.text(x)
            continue
        if callable(x):
            x()
            continue
        if isinstance(x, tuple):
            if x[0] == "pre":
                pre -= 1
            page.block(x[1])
            continue
        if x.hidden or x.tag == "input" and x.attrs.get("type", "").lower() == "hidden":
            continue
        tag = x.tag
        if tag == "br":
            page.newline()
            continue
        if tag == "hr" and not x.visible:
            continue
        if tag == "hr":
            page.block(1)
            page.literal("---")
            page.block(1)
            continue
        if tag == "table" and not flat:
            rows, captions = _rows(x)
            page.block(2)
            for c in captions:
                page.literal(" ".join(render(c, flat=True).split()))
                page.block(1)
            for line in _grid(rows):
                page.literal(line)
                page.block(1)
            page.block(2)
            continue
        gap = 0
        if tag in BLOCKS:
            gap = 2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and counters) else 1
            page.block(gap)
        if tag == "tr" and flat:
            cells.append(0)

            def end_row(p=page, bars=page.bars):
                cells.pop()
                p.bars = min(p.bars, bars)

            todo.append(end_row)
        elif tag in ("td", "th") and cells and x is not root:
            page.bars += cells[-1] > 0
            cells[-1] += 1
        elif tag in ("ul", "ol", "menu", "dir"):
            start = x.attrs.get("start", "1").strip()
            counters.append((int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1) if tag == "ol" else None)
            todo.append(counters.pop)
        elif tag == "li":
            if counters and counters[-1] is not None:
                mark = f"{counters[-1]}. "
                counters[-1] += 1
            else:
                mark = "- "
            page.marker = mark if x.visible else None
            page.indent += len(mark)

            def end_item(p=page, n=len(mark)):
                p.indent -= n
                p.marker = None

            todo.append(end_item)
        elif tag in ("dd", "blockquote"):
            page.indent += 2
            todo.append(lambda p=page: setattr(p, "indent", p.indent - 2))
        if x.space and tag in APART:
            page.space = 1
            todo.append(lambda p=page: setattr(p, "space", 1))
        if gap:
            todo.append((tag if tag in ("pre", "textarea") else "", gap))
        elif tag == "textarea":
            todo.append(("pre", 0))
        children = x.children
        if tag in ("pre", "textarea"):
            pre += 1
            if children and isinstance(children[0], str) and children[0][:1] == "\n":
                children = [children[0][1:], *children[1:]]
        todo.extend(reversed(children))
    return page.done()


def extract(page: str | None) -> str:
    if not page:
        return ""
    return render(parse(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([extract(p.as_py()) for p in batch.column(0)], pa.string())
        yield pa.RecordBatch.from_arrays([text, *batch.columns[1:]], names=batch.schema.names)


def extracted(pages: DataFrame, markup: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text in ``into`` in place of the markup."""
    out, others = through_python(pages, markup, "string", _extract, "string")
    return out.select(*carried(others, into), F.col("value").alias(into))


def op8_html_text(pages: DataFrame) -> DataFrame:
    d = extracted(pages.select("page_id", "html"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return d.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.size(lines).cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))

"""HTML to text by layout.

Per page, a tree builder turns tags into well-nested elements (implied ends of
p, li, dt, dd, option, tr, td, th and table sections; unmatched ends ignored),
visibility rules drop what a browser doesn't show, and a renderer writes blocks
with blank or new lines, list markers with indentation, preformatted text as it
is, and tables as lines whose cells start at their column, spans included. Nothing
recurses, and of each element name the places where it is open are kept, so work
grows with the length of a page, not with its depth. What layout adds is bounded:
indentation ends at INDENT_MOST, a cell reserves at most CELL_MOST places and no
padding goes beyond LINE_MOST (text there follows after two spaces), columns from
COLUMNS_MOST on are not told apart, and a table inside TABLES_DEEP others is
written as plain lines. No text is left out. One map over the pages, no shuffle.

Null pages give null, empty ones the empty text. Repeated rows are rendered each
on its own; extra columns do not take part.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object datalist audio video canvas svg map".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset form".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd dir div dt fieldset figcaption footer header hgroup html li main menu nav optgroup option search section summary hr tr caption legend".split())
ENDS_P = BLOCK - frozenset("body html option optgroup tr caption legend".split())
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
#: Open elements that a start tag ends, and those that bound the search for them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{s: (SECTIONS | {"caption"}, {"table"}) for s in SECTIONS},
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'](?=[^\"']*>))*)>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
INDENT_MOST, CELL_MOST, LINE_MOST, COLUMNS_MOST, TABLES_DEEP = 40, 80, 400, 1000, 6
SPACES = re.compile(r"[ \t\n\r\f\v]+")


class Block:
    """Lines of text being written: pending space and line breaks are settled when text comes."""

    __slots__ = ("lines", "line", "gap", "space", "prefix")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.prefix = 0, False, ""

    def end_line(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line, self.gap = [], 0
        self.gap, self.space = max(self.gap, gap), False

    def _open(self) -> None:
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap = 0

    def put(self, text: str, indent: str) -> None:
        words = SPACES.split(text)
        lead, tail = not words[0], len(words) > 1 and not words[-1]
        body = " ".join(w for w in words if w)
        if not body:
            self.space |= bool(self.line) and len(words) > 1
            return
        if not self.line:
            self._open()
            self.line.append(self.prefix or indent)
            self.prefix = ""
        elif self.space or lead:
            self.line.append(" ")
        self.line.append(body)
        self.space = tail

    def put_lines(self, lines: list[str], indent: str) -> None:
        for x in lines:
            self._open()
            self.lines.append((self.prefix or indent) + x if x else x)
            self.prefix = ""

    def break_line(self) -> None:
        self._open()
        self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def done(self) -> list[str]:
        self.end_line(0)
        return self.lines


class Element:
    __slots__ = ("name", "hidden", "indent", "ordinal", "pre", "block", "rows", "wide", "high")

    def __init__(self, name: str, up: "Element | None"):
        self.name = name
        self.hidden, self.indent, self.pre = (up.hidden, up.indent, up.pre) if up else (False, "", False)
        self.block: Block = up.block if up else Block()
        self.ordinal: int | None = None
        self.rows: list[list[tuple[list[str], int, int]]] | None = None
        self.wide = self.high = 1


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Of cells (lines, columns, rows that each spans) the first column, the column after, and the lines."""
    taken = [0] * (COLUMNS_MOST + 1)  # the row from which a column is free; the last one is shared
    out = []
    for n, row in enumerate(rows):
        at, cells = 0, []
        for lines, wide, high in row:
            while at < COLUMNS_MOST and taken[at] > n:
                at += 1
            to = max(min(at + wide, COLUMNS_MOST), at + 1)
            if high > 1:
                taken[at:to] = [n + high] * (to - at)
            cells.append((at, to, lines))
            at = min(to, COLUMNS_MOST)
        out.append(cells)
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: each cell starts two places after the widest cell that ends before its column."""
    grid = [r for r in placed(rows) if any(any(lines) for _, _, lines in r)]
    ends: dict[int, list[tuple[int, int]]] = {}
    for row in grid:
        for a, b, lines in row:
            ends.setdefault(b, []).append((a, min(max(map(len, lines), default=0), CELL_MOST)))
    # A column in which no cell begins or ends takes no place.
    offset, have = {0: 0}, 0
    for b in sorted(ends.keys() | {a for row in grid for a, _, _ in row}):
        have = max([have, *(offset[a] + wide + 2 for a, wide in ends.get(b, ()))])
        offset[b] = have
    out = []
    for row in grid:
        parts: dict[int, list[tuple[int, str]]] = {i: [] for i in range(max(len(lines) for _, _, lines in row))}
        for a, _, lines in row:
            for i, x in enumerate(lines):
                if x:
                    parts[i].append((min(offset[a], LINE_MOST), x))
        for cells in parts.values():
            line, size = [], 0
            for at, x in cells:
                pad = max(at - size, 2 if line else 0)
                line += [" " * pad, x]
                size += pad + len(x)
            out.append("".join(line).rstrip())
    return out


def spanned(value: str, most: int) -> int:
    return min(int(value), most) if re.fullmatch(r"[1-9]\d{0,5}", value) else 1


class Page:
    def __init__(self):
        self.stack = [Element("", None)]
        self.places: dict[str, list[int]] = {}

    def last(self, names: Iterable[str]) -> int:
        """Where in the stack the innermost open element of these names is; 0 if there is none."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=0)

    @property
    def top(self) -> Element:
        return self.stack[-1]

    def text(self, text: str) -> None:
        e = self.top
        if e.hidden or not text:
            return
        if e.name == "table" or e.name in SECTIONS or e.name == "tr":
            if not text.strip():
                return
        if e.pre:
            parts = text.replace("\r\n", "\n").split("\n")
            for i, p in enumerate(parts):
                if i:
                    e.block.break_line()
                if p:
                    if not e.block.line:
                        e.block._open()
                        e.block.line.append(e.block.prefix or e.indent)
                        e.block.prefix = ""
                    e.block.line.append(p)
        else:
            e.block.put(text, e.indent)

    def close_to(self, names: Iterable[str], bounds: Iterable[str]) -> None:
        at = self.last(names)
        if at and at > self.last(bounds):
            while len(self.stack) > at:
                self.pop()

    def table(self) -> Element | None:
        at = self.last(("table",))
        return self.stack[at] if at else None

    def open(self, name: str, rest: str) -> None:
        if name in IMPLIED:
            self.close_to(*IMPLIED[name])
        if name in ENDS_P:
            self.close_to({"p"}, {"table", "td", "th", "button", "caption"})
        if name == "body":
            self.close_to({"head"}, set())
        if name in ("td", "th") and self.last(("table",)) and self.last(("tr",)) < self.last(("table",)):
            self.open("tr", "")
        up = self.top
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest else {}
        hidden = up.hidden or name in HIDDEN or "hidden" in attributes or bool(UNSHOWN.search(attributes.get("style", "")))
        block = up.block
        if not hidden and name in BLOCK:
            block.end_line(2 if name in SPACED and not (name in ("ul", "ol") and up.name == "li") else 1)
        if name == "br":
            if not hidden:
                block.break_line() if block.line else block.end_line(1)
            return
        if name == "img" and not hidden and attributes.get("alt"):
            block.put(entities.unescape(attributes["alt"]), up.indent)
        if name in VOID:
            return
        e = Element(name, up)
        e.hidden = hidden
        if name == "pre":
            e.pre = True
        if name in ("ul", "ol", "menu"):
            start = attributes.get("start", "")
            e.ordinal = (int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if name == "ol" else None
            e.indent = up.indent
        if name == "li":
            holder = self.stack[self.last(("ul", "ol", "menu"))]
            mark = "- "
            if holder.ordinal is not None:
                mark, holder.ordinal = f"{holder.ordinal}. ", holder.ordinal + 1
            if not hidden:
                block.prefix = up.indent + mark
            e.indent = (up.indent + " " * len(mark))[:INDENT_MOST]
        if name in ("blockquote", "dd"):
            e.indent = (up.indent + "  ")[:INDENT_MOST]
        if name == "table" and len(self.places.get("table", ())) < TABLES_DEEP:
            e.rows = []
        t = self.table()
        if name == "tr" and not hidden and t is not None and t.rows is not None:
            t.rows.append([])
        if name in ("td", "th"):
            e.pre = False
            if t is not None and t.rows is None:
                block.space |= bool(block.line)
            else:
                e.block, e.indent = Block(), ""
                e.wide, e.high = spanned(attributes.get("colspan", ""), COLUMNS_MOST), spanned(attributes.get("rowspan", ""), 65534)
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(e)

    def pop(self) -> None:
        e = self.stack.pop()
        self.places[e.name].pop()
        up = self.top
        if e.hidden:
            return
        if e.name in ("td", "th"):
            t = self.table()
            if t is None:
                up.block.put_lines(e.block.done(), up.indent)
            elif t.rows is not None:
                if not t.rows:
                    t.rows.append([])
                t.rows[-1].append((e.block.done(), e.wide, e.high))
        elif e.name == "table" and e.rows is not None:
            e.block.end_line(2)
            e.block.put_lines(aligned(e.rows), up.indent)
            e.block.end_line(2)
            e.block.gap = 2
        elif e.name in BLOCK:
            if e.name == "li":
                e.block.prefix = "" if e.block.line or not e.block.prefix else e.block.prefix
            e.block.end_line(2 if e.name in SPACED and not (e.name in ("ul", "ol") and up.name == "li") else 1)
            if e.name == "li":
                e.block.prefix = ""

    def close(self, name: str) -> None:
        bounds = set() if name in ("table", "body", "html", "td", "th", "tr") or name in SECTIONS else {"td", "th", "table"}
        self.close_to({name}, bounds if name != "table" else set())

    def finish(self) -> str:
        while len(self.stack) > 1:
            self.pop()
        return "\n".join(x.rstrip() for x in self.top.block.done()).strip("\n")


def rendered(source: str) -> str:
    """The visible text of a page."""
    page, at = Page(), 0
    while m := TOKEN.search(source, at):
        if m.start() > at:
            page.text(entities.unescape(source[at : m.start()]))
        at = m.end()
        if not (name := (m[2] or "").lower()):
            continue
        if m[1]:
            page.close(name)
            continue
        page.open(name, m[3])
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(source, at)
            stop = end.start() if end else len(source)
            page.text(entities.unescape(source[at:stop]) if name in ("textarea", "title") else source[at:stop])
            at = stop
    page.text(entities.unescape(source[at:]))
    return page.finish()


def _renderer(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__html"):
                texts = [None if x is None else rendered(x) for x in batch.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "text"])

    return run


def page_texts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep` and the visible text of each page."""
    given = pages.select(*keep, F.col(html).alias("__html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + ["text string"])
    return given.mapInArrow(_renderer(list(keep)), schema)

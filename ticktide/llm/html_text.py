"""Text of web pages as a reader sees it: a tree builder and a layout-aware renderer.

The builder scans the page once, from left to right, by the states of the HTML
tokenizer: tags with quoted, unquoted and missing values, comments, raw-text
elements. It closes what the HTML rules imply (the head, paragraphs, list items,
table rows and cells, options) and leaves out what is not shown: scripts, styles,
templates, the head, elements that are hidden by attribute or inline ``display``,
closed dialogs, closed ``details`` but for their summary. ``visibility`` is
inherited, and a visible element in a hidden one is shown. The renderer emits all
visible text with a blank line around paragraphs, headings, lists and tables, a
line for each other block, markers and indents for list items, padded columns for
table cells with their row and column spans, and ``pre`` as it stands.

Defined cases: null and empty pages give an empty text; open elements are closed at
the page's end; a tag, comment or quoted value that is not closed takes the rest of
the page with it, as in a browser; NUL and lone ``<`` are text; cells outside a
table are text with spaces around; rows that repeat are pages of their own; an
empty table gives an empty result; other columns are not read. Depth and length
have no limit: nothing recurses, and time follows the length of the page and its
text. So that layout stays in proportion to text, indents stop growing at ``DEEPEST``
levels, tables in more than ``NESTED`` tables are plain blocks, cells above ``WIDE``
characters do not widen their column, and a table whose padding would be many times
its text has its cells parted by tabs instead.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template head title noscript iframe noembed noframes datalist object audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCKS = SPACED | frozenset("html body div section article aside header footer nav main address fieldset form figcaption details summary li dt dd tr caption center dialog hgroup legend menu search option optgroup select".split())
#: Elements whose end tag does not close a block that was opened within them.
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = BLOCKS - frozenset("html body li dt dd tr caption option optgroup select legend".split())
#: A start tag closes an open one of these, up to the nearest of the borders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Any other start tag ends an open head.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Levels of indent, of tables with columns, and characters of a cell that widen a column.
DEEPEST, NESTED, WIDE = 32, 8, 100
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BETWEEN = re.compile(r"[ \t\n\f\r/]*+")
_TAG_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*+")
_NAME = re.compile(r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+")
_EQUALS = re.compile(r"[ \t\n\f\r]*+=[ \t\n\f\r]*+")
_BARE = re.compile(r"[^ \t\n\f\r>]++")
_COMMENT_END = re.compile(r"--!?>")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I) for tag in sorted(RAW)}


class Node:
    __slots__ = ("children", "tag", "attrs", "shown")

    def __init__(self, tag: str, attrs: dict[str, str], shown: bool = True):
        self.tag, self.attrs, self.shown, self.children = tag, attrs, shown, []


def unescaped(text: str) -> str:
    """``text`` with its character references resolved; numbers too large for one give U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("&#xfffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


def scan_tag(page: str, at: int) -> tuple[dict[str, str], int, bool] | None:
    """(attributes, end, ends with a slash) of a tag from behind its name; None if the page ends within it."""
    attrs: dict[str, str] = {}
    n = len(page)
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= n:
            return None
        if page[at] == ">":
            return attrs, at + 1, page[at - 1] == "/"
        name = _NAME.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ('"', "'"):
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            elif bare := _BARE.match(page, at):
                value, at = bare[0], bare.end()
        attrs.setdefault(name[0].lower(), value)


class Open:
    """The open elements, and where those of a kind are: no look-up walks through them all."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tag: str) -> int:
        """The depth of the innermost element of a kind, 0 if there is none."""
        own = self.at.get(tag)
        return own[-1] if own else 0

    def first_above(self, tag: str, depth: int) -> int:
        """The depth of the outermost element of a kind that is deeper than ``depth``, 0 if there is none."""
        own = self.at.get(tag, ())
        k = bisect_right(own, depth)
        return own[k] if k < len(own) else 0

    def push(self, node: Node) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCKS:
            self.blocks.append(depth)

    def pop_to(self, depth: int) -> None:
        for node in self.nodes[depth:]:
            self.at[node.tag].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        del self.nodes[depth:]


def _look(tag: str, attrs: dict[str, str]) -> tuple[bool, bool | None]:
    """(whether it and all in it is left out, its own visibility if it states one)."""
    gone = tag in UNSEEN or "hidden" in attrs or tag == "dialog" and "open" not in attrs
    if "style" not in attrs:
        return gone, None
    stated = {k.lower(): v.lower() for k, v in _STYLE.findall(unescaped(attrs["style"]))}
    seen = {"hidden": False, "collapse": False, "visible": True}.get(stated.get("visibility", ""))
    return gone or stated.get("display") == "none", seen


class Builder:
    """The tree of what is shown."""

    def __init__(self):
        self.root = Node("body", {})
        self.open = Open(self.root)
        self.shut = 0  # depth of the open element that is left out with all in it

    def close_to(self, depth: int) -> None:
        self.open.pop_to(depth)
        if self.shut >= len(self.open.nodes):
            self.shut = 0

    def leave_head(self) -> None:
        if self.open.nodes[-1].tag == "head":
            self.close_to(len(self.open.nodes) - 1)

    def add(self, child: Node | str) -> None:
        if not self.shut:
            self.open.nodes[-1].children.append(child)

    def text(self, text: str) -> None:
        if not text:
            return
        top = self.open.nodes[-1]
        if top.tag == "head" and unescaped(text).strip(" \t\n\f\r"):
            self.leave_head()
            top = self.open.nodes[-1]
        if top.shown:
            self.add(unescaped(text))

    def end(self, tag: str) -> None:
        if tag == "p" and not self.open.last("p"):
            self.add(Node("p", {}))
            return
        if tag == "br":
            self.leave_head()
            self.add(Node("br", {}))
            return
        depth = self.open.last(tag)
        if not depth:
            return
        # the end tag of something outside the innermost table is not for this one, but for its own parts
        if tag not in IMPLIED and tag not in ("table", "html") and self.open.last("table") > depth:
            return
        if tag in FORMATS and not self.shut and self.open.blocks and self.open.blocks[-1] > depth:
            return
        self.close_to(depth)

    def imply(self, tag: str) -> None:
        """Close what a start tag closes."""
        if tag not in IN_HEAD:
            self.leave_head()
        if tag in CLOSES_P and (depth := self.open.last("p")):
            if all(self.open.last(x) < depth for x in ("table", "td", "th", "button", "caption")):
                self.close_to(depth)
        if tag in IMPLIED:
            closes, borders = IMPLIED[tag]
            border = max((self.open.last(x) for x in borders), default=0)
            if top := min((d for x in closes if (d := self.open.first_above(x, border))), default=0):
                self.close_to(top)

    def start(self, tag: str, attrs: dict[str, str], slash: bool) -> Node:
        """The new element; it is open unless it can have no content."""
        self.imply(tag)
        gone, seen = _look(tag, attrs)
        if tag in ("html", "body") and not self.shut:
            if gone:
                self.root.attrs["hidden"] = ""
            if seen is not None:
                self.root.shown = seen
            return self.root
        node = Node(tag, attrs, self.open.nodes[-1].shown if seen is None else seen)
        if not gone:
            self.add(node)
        if tag in VOID or slash and tag in ("svg", "math", "path") or tag in RAW:
            return node
        self.open.push(node)
        if gone and not self.shut:
            self.shut = len(self.open.nodes) - 1
        return node


def build(page: str) -> Node:
    out, at, n = Builder(), 0, len(page)
    began = 0  # of the text that is not added yet
    while (at := page.find("<", at)) >= 0:
        c = page[at + 1 : at + 2]
        if c.isascii() and c.isalpha():
            name = _TAG_NAME.match(page, at + 1)
            out.text(page[began:at])
            tag, scanned = name[0].lower(), scan_tag(page, name.end())
            if scanned is None:
                return out.root
            attrs, at, slash = scanned
            node = out.start(tag, attrs, slash)
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                if tag in ("textarea", "xmp") and node.shown:
                    body = page[at : end.start() if end else n]
                    node.children.append(unescaped(body) if tag == "textarea" else body)
                if end is None or (scanned := scan_tag(page, end.end())) is None:
                    return out.root
                at = scanned[1]
        elif c == "/":
            name = _TAG_NAME.match(page, at + 2)
            if name is None and at + 2 >= n:
                break
            out.text(page[began:at])
            if name is None:  # </> is nothing, </ and something else a comment
                at = page.find(">", at + 2) + 1
                if not at:
                    return out.root
            else:
                scanned = scan_tag(page, name.end())
                if scanned is None:
                    return out.root
                at = scanned[1]
                out.end(name[0].lower())
        elif c == "!" or c == "?":
            out.text(page[began:at])
            if page.startswith("<!--", at):
                at += 4
                if page.startswith((">", "->"), at):
                    at = page.find(">", at) + 1
                else:
                    end = _COMMENT_END.search(page, at)
                    if end is None:
                        return out.root
                    at = end.end()
            else:
                at = page.find(">", at) + 1
                if not at:
                    return out.root
        else:
            at += 1
            continue
        began = at
    out.text(page[began:])
    return out.root


class Flow:
    """Lines of text with collapsed white space, breaks and indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a space before what comes next
        self.gap = 0  # lines to break before what comes next
        self.indents: list[str] = []
        self.marker = ""

    def _start(self) -> None:
        if self.gap and (self.lines or self.now):
            self._end()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
        self.gap = 0

    def _end(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def _lead(self) -> None:
        if not self.now:
            lead = "".join(self.indents[:DEEPEST])
            if self.marker:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            self.now.append(lead)
            self.space = False

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        self._start()
        fresh = not self.now
        self._lead()
        if not fresh and (self.space or words[0] == " "):
            self.now.append(" ")
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def literal(self, text: str) -> None:
        """Lines as they are."""
        for k, line in enumerate(text.split("\n")):
            if k:
                if not self.now:
                    self._lead()
                self._end()
            if line:
                self._start()
                spaced = self.space and bool(self.now)
                self._lead()
                self.now.append(f" {line}" if spaced else line)
                self.space = False

    def broken(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.space = False

    def new_line(self) -> None:
        """A line break of the author's."""
        self._start()
        self._lead()
        self._end()

    def done(self) -> str:
        self._end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines).lstrip("\n")


def _span(node: Node, name: str, most: int) -> int:
    text = node.attrs.get(name, "").strip()
    return max(1, min(int(text), most)) if text.isascii() and text.isdigit() and len(text) < 8 else 1


class Cell:
    __slots__ = ("lines", "at", "end", "rows")

    def __init__(self, text: str, columns: int, rows: int):
        self.lines, self.at, self.end, self.rows = text.split("\n"), 0, columns, rows

    def width(self) -> int:
        return min(WIDE, max(map(len, self.lines)))


def _placed(rows: list[list[Cell]]) -> bool:
    """Give each cell its first and end column, beside cells of earlier rows that reach down.

    False if that takes many times as many steps as there are cells.
    """
    above: list[tuple[int, int, int]] = []  # (first column, end, row that it no longer covers)
    steps = (1 << 16) + 64 * sum(map(len, rows))
    for r, row in enumerate(rows):
        if not row:
            continue
        at, k, new = 0, 0, []
        above = [x for x in above if x[2] > r]
        steps -= len(above)
        if steps < 0:
            return False
        for cell in row:
            while k < len(above) and above[k][0] <= at:
                at = max(at, above[k][1])
                k += 1
            cell.at, cell.end = at, at + cell.end
            if cell.rows > 1:
                new.append((cell.at, cell.end, r + cell.rows))
            at = cell.end
        if new:
            above = sorted(above + new)
    return True


def _unaligned(rows: list[list[Cell]]) -> str:
    return "\n".join("\t".join(" ".join(c.lines) for c in row) for row in rows if row)


def _table(rows: list[list[Cell]]) -> str:
    """Rows of cells with padded columns; a cell's lines stay in its columns."""
    if not _placed(rows):
        return _unaligned(rows)
    # only columns at which a cell begins or ends count, however far it spans
    edges = sorted({x for row in rows for c in row for x in (c.at, c.end)})
    number = {x: k for k, x in enumerate(edges)}
    width = [0] * len(edges)
    spanning: list[Cell] = []
    for row in rows:
        for c in row:
            c.at, c.end = number[c.at], number[c.end]
            if c.end == c.at + 1:
                width[c.at] = max(width[c.at], c.width())
            else:
                spanning.append(c)
    begin = [0]
    for w in width:
        begin.append(begin[-1] + w + 2)
    if spanning:
        wider = [0] * len(edges)  # what the last column of a spanning cell lacks
        for c in spanning:
            wider[c.end - 1] = max(wider[c.end - 1], c.width() - (begin[c.end] - begin[c.at] - 2))
        begin = [0]
        for w, more in zip(width, wider, strict=True):
            begin.append(begin[-1] + w + more + 2)
    padded = sum(begin[max(c.at for c in row)] * max(len(c.lines) for c in row) for row in rows if row)
    if padded > 4096 + 16 * sum(len(x) - x.count(" ") for row in rows for c in row for x in c.lines):
        return _unaligned(rows)
    out = []
    for row in rows:
        i, live = 0, row
        while live := [c for c in live if len(c.lines) > i]:
            line = ""
            for c in live:
                if c.lines[i]:
                    line = line.ljust(begin[c.at] if not line or len(line) < begin[c.at] - 1 else len(line) + 2) + c.lines[i]
            out.append(line.rstrip())
            i += 1
    return "\n".join(out)


def render(root: Node) -> str:
    if "hidden" in root.attrs:
        return ""
    flows = [Flow()]
    tables: list[list[list[Cell]] | None] = []  # None: a table that is a plain block
    numbers: list[int | None] = []
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.literal(node) if pre else flow.text(node)
            continue
        tag = node.tag
        inside = tables[-1] if tables else None
        if not leaving:
            children = node.children
            if tag == "br":
                flow.new_line()
                continue
            if tag == "hr":
                flow.broken(2)
                continue
            if tag == "img":
                continue  # its alternative text is shown only if the image is not
            if tag == "input":
                if node.attrs.get("type", "text").lower() in ("submit", "button", "reset") and node.attrs.get("value") and node.shown:
                    flow.text(f" {unescaped(node.attrs['value'])} ")
                continue
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag == "table":
                flow.broken(2)
                tables.append([] if len(tables) < NESTED else None)
            elif tag in ("td", "th"):
                if inside is None:
                    flow.space = True
                else:
                    if not inside:
                        inside.append([])
                    flows.append(Flow())
            elif tag == "tr" and inside is not None:
                inside.append([])
            elif tag in BLOCKS:
                inner = tag in ("ul", "ol") and numbers
                flow.broken(2 if tag in SPACED and not inner else 1)
            elif tag in ("select", "button", "textarea"):
                flow.space = True
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                numbers.append((int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if tag == "ol" else None)
            elif tag == "li":
                mark = "- "
                if numbers and numbers[-1] is not None:
                    mark = f"{numbers[-1]}. "
                    numbers[-1] += 1
                flow.indents.append(" " * len(mark))
                flow.marker = mark
            elif tag in ("dd", "blockquote"):
                flow.indents.append("  ")
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
                if tag != "xmp" and children and isinstance(children[0], str) and children[0].startswith("\n"):
                    children = [children[0][1:], *children[1:]]
            todo.append((node, True))
            todo += [(c, False) for c in reversed(children)]
            continue
        if tag == "table":
            grid = tables.pop()
            if grid and any(grid):
                while grid and not grid[-1]:
                    grid.pop()
                flow.literal(_table(grid))
            flow.broken(2)
        elif tag in ("td", "th"):
            if inside is None:
                flow.space = True
            else:
                cell = flows.pop().done()
                to_end = node.attrs.get("rowspan", "").strip() == "0"
                inside[-1].append(Cell(cell, _span(node, "colspan", 1000), 65534 if to_end else _span(node, "rowspan", 65534)))
        elif tag in BLOCKS and not (tag == "tr" and inside is not None):
            inner = tag in ("ul", "ol") and len(numbers) > 1
            flow.broken(2 if tag in SPACED and not inner else 1)
        if tag in ("ul", "ol", "menu"):
            numbers.pop()
        elif tag == "li":
            if flow.marker and flow.indents and len(flow.indents[-1]) == len(flow.marker):
                flow.marker = ""
            flow.indents.pop()
        elif tag in ("dd", "blockquote"):
            flow.indents.pop()
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
            flow.space = tag == "textarea"
    return flows[0].done()


def page_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("page_id", batch.schema.field("page_id").type), ("text", pa.string())])
            texts = ((i.as_py(), page_text(x.as_py())) for i, x in zip(batch["page_id"], batch["html"]))
            yield from tokens.batched(((4 * len(t), (i, t)) for i, t in texts), schema)

    return rows.mapInArrow(run, f"page_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the visible text of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))

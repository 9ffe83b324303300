"""Layout-aware text of HTML pages (operator 8).

A tokenizer feeds a tree builder that closes implied tags (a list item ends the one before,
a block ends a paragraph, a cell ends a cell, and so on) and knows void elements and raw text.
A cell outside a row begins one, and what stands in a table but in no cell moves before it, as
in browsers.  The renderer then walks the tree: elements that browsers don't show (head, script,
style, template, noscript, the hidden attribute, a style of display:none, definitions in svg,
annotations in math) give nothing; visibility:hidden hides an element's own text, and what is inside
unless it says visibility:visible again; text in svg, math and textarea is shown,
and all options of a select, a line each;
blocks stand on lines of their own, with an empty line around paragraphs, headings, lists and
tables; list items get a bullet or their number (start and value count) and an indent; cells of a table's
rows are padded to columns (colspan and rowspan count, up to the standard's bounds of 1,000 columns and
65,534 rows, and to the table's end); pre keeps its spaces; other runs of white space become one space.

Null html gives null text; empty html, an empty text.  Unclosed or misnested tags never fail.
The walk keeps its own stack, so depth is bounded by memory alone, but tables in tables beyond
``NESTED`` levels are shown as plain blocks.  Long pages are done like others, in time about proportional to their
length.  Rows that repeat a page_id are done each by its own html; other columns are left out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import column

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist meta link".split())
# Not shown within the element of the key.
UNSEEN_IN = {
    "svg": frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter desc metadata".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr legend li main menu nav section summary caption tr thead tbody tfoot".split())
# Elements on lines of their own: blocks, and those inline elements that stand apart.
LINED = BLOCK | frozenset("option optgroup textarea text".split())
# An opening tag (key) closes those open elements, unless one of the barriers is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["tbody"]
# An opening tag (key) goes back to the nearest of those elements.
ROOM = {"tr": {"tbody", "thead", "tfoot", "table"}, "tbody": {"table"}}
ROOM["td"] = ROOM["th"] = ROOM["tr"] | {"tr"}
ROOM["thead"] = ROOM["tfoot"] = ROOM["caption"] = ROOM["colgroup"] = ROOM["tbody"]
GROUPS = {"tbody", "thead", "tfoot", "tr", "colgroup"}
# What may stand in them; all else moves before the table.
PARTS = GROUPS | {"td", "th", "caption", "col", "script", "style", "template"}
SCOPE = {"td", "th", "table", "caption", "button", "object", "html"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
HIDES = re.compile(r"hidden|style", re.I)
ATTR = re.compile(r"([^\s/=>][^\s/=>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'][^\s]*))?")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
INTEGER = re.compile(r"\s*([+-]?\d{1,9})")
#: Levels of tables in tables that are laid out.
NESTED = 100
WHITE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(attrs: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or "")
    return out


def number(attrs: str, name: str, otherwise: int) -> int:
    """An attribute's integer."""
    m = INTEGER.match(html.unescape(attributes(attrs).get(name, "").strip("\"'"))) if name in attrs.lower() else None
    return int(m[1]) if m else otherwise


def shown(attrs: str) -> tuple[bool, bool | None]:
    """Whether the element is displayed, and whether its text is visible (None: as around it).

    A display in the style goes before the hidden attribute.
    """
    if not HIDES.search(attrs):
        return True, None
    values = attributes(attrs)
    style: dict[str, tuple[bool, str]] = {}
    for part in COMMENT.sub("", html.unescape(values.get("style", "").strip("\"'"))).split(";"):
        name, _, value = part.partition(":")
        name, (value, mark, _) = name.strip().lower(), value.strip().lower().partition("!")
        if value.strip() and (mark or not style.get(name, (False,))[0]):
            style[name] = (bool(mark), value.strip())
    visible = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(style.get("visibility", (False, ""))[1])
    return (style["display"][1] != "none" if "display" in style else "hidden" not in values), visible


def displayed(node: Node) -> bool:
    return not node.attrs or shown(node.attrs)[0]


def sight(node: Node, around: bool) -> bool:
    """Whether text right in ``node`` is visible."""
    own = shown(node.attrs)[1] if node.attrs else None
    return around if own is None else own


def parse(page: str) -> Node:
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    is_open: Counter = Counter()  # so that deep nesting costs no walk for a tag that isn't open

    def add(child) -> None:
        """Puts ``child`` into the open element, or before the table if it may not stand there."""
        i = len(stack) - 1
        if child.strip() if isinstance(child, str) else child.tag not in PARTS:
            while stack[i].tag in GROUPS:
                i -= 1
            if stack[i].tag == "table":
                stack[i - 1].children.insert(len(stack[i - 1].children) - 1, child)
                return
        stack[-1].children.append(child)

    def text(s: str) -> None:
        if s:
            add(html.unescape(s) if "&" in s else s)

    def cut(i: int) -> None:
        is_open.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def close_to(names, barriers) -> None:
        while any(is_open[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    cut(i)
                    break
                if stack[i].tag in barriers:
                    return

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "p" and not is_open["p"]:
                add(Node("p"))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    cut(i)
                    break
                if not is_open[name] or stack[i].tag in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                    break
            continue
        if name in CLOSES:
            close_to(*CLOSES[name])
        if name in BLOCK:
            close_to({"p"}, SCOPE)
            if name != "html":
                close_to({"head"}, set())
        if name in ROOM and is_open["table"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ROOM[name]:
                    cut(i + 1)
                    break
            if name in ("td", "th") and stack[-1].tag != "tr":
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
                is_open["tr"] += 1
        elif name == "table" and is_open["table"]:
            i = len(stack) - 1
            while stack[i].tag in GROUPS:
                i -= 1
            if stack[i].tag == "table":  # a table ends the one that it would stand in outside a cell
                cut(i)
        node = Node(name, m[3])
        if any(is_open[k] and name in names for k, names in UNSEEN_IN.items()):
            node.attrs = "hidden " + m[3]
        add(node)
        if name in VOID or m[3].endswith("/") and (is_open["svg"] or is_open["math"] or name in ("path", "circle", "rect", "line", "use")):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at : stop.start() if stop else end]
            if name == "textarea":
                body = re.sub(r"\A\r?\n", "", body)
            if body:
                node.children.append(html.unescape(body) if name in ("title", "textarea") else body)
            at = stop.end() if stop else end
            continue
        stack.append(node)
        is_open[name] += 1
    return root


class Lines:
    """Text under construction: lines, the space and the empty line that are due."""

    def __init__(self):
        self.lines, self.now, self.gap, self.space = [], [], False, False

    def word(self, s: str, indent: str) -> None:
        if not s:
            return
        flat = WHITE.sub(" ", s)
        if flat[0] == " " and self.now:
            self.space = True
        core = flat.strip(" ")
        if core:
            if not self.now:
                self.now.append(indent)
            elif self.space:
                self.now.append(" ")
            self.now.append(core)
            self.space = False
        if flat[-1] == " ":
            self.space = True

    def line(self) -> None:
        if self.now:
            done = "".join(self.now).rstrip(" ")
            if done.strip():
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
                self.lines.append(done)
            self.now = []
        self.space = False

    def raw(self, s: str, indent: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                if self.now:
                    self.line()
                elif self.lines and not self.gap:
                    self.lines.append("")
            if part:
                if not self.now:
                    self.now.append(indent)
                self.now.append(part)

    def text(self) -> str:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def wide(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _rows(table: Node, seen: bool):
    """The rows of a table, the last of each group marked, and whether their text is visible."""
    for n in table.children:
        if isinstance(n, str) or not displayed(n):
            continue
        if n.tag == "tr":
            yield n, False, sight(n, seen)
        elif n.tag in ("thead", "tbody", "tfoot"):
            rows = [r for r in n.children if not isinstance(r, str) and r.tag == "tr" and displayed(r)]
            for i, r in enumerate(rows):
                yield r, i == len(rows) - 1, sight(r, sight(n, seen))


def _table(table: Node, out: Lines, indent: str, depth: int, seen: bool) -> None:
    for n in table.children:
        if not isinstance(n, str) and n.tag == "caption" and displayed(n):
            render(n, out, indent, depth, sight(n, seen))
            out.line()
    grid = []
    below: dict[int, int] = {}  # for each column, the rows that a cell from above still takes
    for row, last, visible in _rows(table, seen):
        cells: list[list[str]] = []

        def skip(cells=cells):
            while below.get(len(cells), 0) > 0:
                below[len(cells)] -= 1
                cells.append([])

        for n in row.children:
            # the tree builder leaves nothing else that is shown in a row
            if isinstance(n, str) or n.tag not in ("td", "th") or not displayed(n):
                continue
            skip()
            inner = Lines()
            render(n, inner, "", depth + 1, sight(n, visible))
            rows = min(number(n.attrs, "rowspan", 1), 65_534)
            for i in range(max(1, min(number(n.attrs, "colspan", 1), 1_000))):
                if rows != 1:
                    below[len(cells)] = rows - 1 if rows > 0 else 1 << 30
                cells.append([] if i else [x for x in inner.text().split("\n") if x])
        skip()
        if last:
            below.clear()
        if any(cells):
            grid.append(cells)
    widths: list[int] = []
    for cells in grid:
        for i, c in enumerate(cells):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], max(map(wide, c), default=0))
    for cells in grid:
        for k in range(max(1, *(len(c) for c in cells))):
            parts = [c[k] if k < len(c) else "" for c in cells]
            padded = "  ".join(p + " " * (w - wide(p)) for p, w in zip(parts, widths, strict=False))
            out.line()
            out.now = [indent, padded.rstrip(" ")]
            out.line()


def render(top: Node, out: Lines, indent: str = "", depth: int = 0, seen: bool = True) -> None:
    """Walks ``top``'s children."""
    todo: list = [(top, 0, indent, False, None, seen)]  # node, next child, indent, keeps spaces, list counter, visible
    while todo:
        node, i, indent, keeps, count, seen = todo.pop()
        if i == len(node.children):
            if node.tag in LINED:
                out.line()
            inside = node.tag in ("ul", "ol") and todo and todo[-1][0].tag == "li"
            if node.tag in SPACED and not inside:
                out.gap = True
            continue
        todo.append((node, i + 1, indent, keeps, count, seen))
        child = node.children[i]
        if isinstance(child, str):
            if not seen:
                continue
            if keeps:
                out.raw(child, indent)
            else:
                out.word(child, indent)
            continue
        tag = child.tag
        if tag in UNSEEN or not displayed(child):
            continue
        if tag == "br":
            if out.now:
                out.line()
            elif out.lines:
                out.gap = True
            continue
        if tag == "hr":
            out.line()
            continue
        if tag == "img":
            continue
        if tag in LINED:
            out.line()
        nested = node.tag == "li" and tag in ("ul", "ol")
        if tag in SPACED and not nested:
            out.gap = True
        within = sight(child, seen)
        if tag == "table" and depth < NESTED:
            _table(child, out, indent, depth, within)
            out.gap = True
            continue
        inner, own = indent, None
        if tag in ("ul", "ol", "menu", "dir"):
            own = [number(child.attrs, "start", 1)] if tag == "ol" else [None]
        elif tag == "li":
            at = count[0] if count else None
            if at is not None:
                at = number(child.attrs, "value", at)
                count[0] = at + 1
            mark = "- " if at is None else f"{at}. "
            inner = indent + " " * len(mark)
            if child.children and within:
                out.now = [indent, mark]
                out.space = False
        elif tag in ("blockquote", "dd"):
            inner = indent + "  "
        elif tag in ("td", "th"):
            out.word(" ", indent)
        todo.append((child, 0, inner, keeps or tag in ("pre", "textarea"), own, within))


def page_text(page: str) -> str:
    out = Lines()
    render(parse(page), out)
    return out.text()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [None if p is None else page_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([None if t is None else len(t) for t in made], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row with columns page_id, url and html."""
    return pages.select(*(column(c).alias(c) for c in ("page_id", "url", "html"))).mapInArrow(_run, "page_id long, url string, text string, n_chars long")

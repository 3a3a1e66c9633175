"""Visible text of HTML pages, laid out as a text browser would.

A tolerant tokenizer feeds a tree builder that supplies implied tags (a paragraph ends before a block, a list item
before the next, table rows and bodies appear where cells need them, text that can't stand in a table moves before it).
Visibility rules take subtrees out. The rest is rendered: blocks on lines of their own, with blank lines where browsers
have margins; list items with bullets or numbers, indented by depth; table cells padded to their column's width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
DECODED = frozenset(("textarea", "title"))  # of RAW, those with character references
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base area param source track rp desc metadata defs symbol clippath mask pattern annotation annotation-xml".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table hr menu fieldset details".split())
BLOCK = MARGIN | frozenset("html body div section article aside header footer main nav address form li dt dd figcaption legend center dir summary optgroup option caption mtr thead tbody tfoot tr td th dialog search hgroup xmp plaintext".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt plaintext xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_TABLE = frozenset("table thead tbody tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: What an end tag, or an implied end, does not reach across.
SCOPE = frozenset("html table td th caption template object applet marquee".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NO_SHOW = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
#: Elements whose text stands by itself in a line: labels of drawings, cells of formulas.
SPACED = frozenset("text mtd".split())
_SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    """An element. `up` is the open element that it was opened in, which is not its place for one moved before a table."""

    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


class TreeBuilder:
    """Builds the tree of one page."""

    def __init__(self) -> None:
        self.root = Node("html", {}, None)
        self.now = self.root

    def feed(self, html: str) -> Node:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            at = lt
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = n if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), at) or (html.startswith("</", at) and not html[at + 2 : at + 3].isalpha()):
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            elif m := _TAG.match(html, at):
                close, name, raw = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
                at, name = m.end(), name.lower()
                if close:
                    self.end(name)
                else:
                    self.start(name, _attributes(raw) if raw.strip(" /\n\t") else {}, raw.endswith("/"))
                    if name in RAW and self.now.tag == name:
                        end = n if name == "plaintext" else self._raw_end(html, at, name)
                        if end > at:
                            body = html[at:end]
                            self.now.kids.append(unescape(body) if name in DECODED else body)
                        self.end(name)
                        close_ = html.find(">", end)
                        at = n if close_ < 0 else close_ + 1
            elif at + 1 < n and (html[at + 1].isascii() and html[at + 1].isalpha() or html[at + 1] == "/"):
                at = n  # a tag that never ends
            else:
                self.text("<")
                at += 1
        return self.root

    @staticmethod
    def _raw_end(html: str, at: int, name: str) -> int:
        m = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
        return m.start() if m else len(html)

    def text(self, raw: str) -> None:
        value = unescape(raw) if "&" in raw else raw
        if self.now.tag in IN_TABLE and value.strip():
            table = self._table()
            if table is not None and table.up is not None:  # moved before the table
                kids = table.up.kids
                kids.insert(len(kids) - 1 - kids[::-1].index(table), value)
                return
        if self.now.tag == "head" and value.strip():
            self._pop("head")
        self.now.kids.append(value)

    def _table(self) -> Node | None:
        node: Node | None = self.now
        while node is not None and node.tag != "table":
            node = node.up
        return node

    def _open(self, names: frozenset | tuple, stops: frozenset | tuple = SCOPE) -> Node | None:
        """The nearest open element of `names` that no element of `stops` hides."""
        node: Node | None = self.now
        while node is not None:
            if node.tag in names:
                return node
            if node.tag in stops:
                return None
            node = node.up
        return None

    def _pop(self, name: str, stops: frozenset | tuple = ()) -> bool:
        if (node := self._open((name,), stops)) is None or node.up is None:
            return False
        self.now = node.up
        return True

    def _push(self, name: str, attrs: dict[str, str]) -> None:
        node = Node(name, attrs, self.now)
        self.now.kids.append(node)
        self.now = node

    def start(self, name: str, attrs: dict[str, str], closed: bool) -> None:
        if name == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if name == "body":
            self._pop("head")
            if self._open(("body",), ()) is not None:
                return
        if self.now.tag == "head" and name not in IN_HEAD:
            self._pop("head")
        if name in ENDS_P:
            self._pop("p", SCOPE | {"button"})
        if name in HEADINGS and self.now.tag in HEADINGS:
            self.now = self.now.up or self.root
        if name == "li":
            self._pop("li", SCOPE | {"ul", "ol", "menu", "dir"})
        elif name in ("dt", "dd"):
            if (node := self._open(("dt", "dd"), SCOPE | {"dl"})) is not None:
                self.now = node.up or self.root
        elif name in ("option", "optgroup"):
            if self.now.tag == "option":
                self.now = self.now.up or self.root
            if name == "optgroup" and self.now.tag == "optgroup":
                self.now = self.now.up or self.root
        elif name in TABLE_PARTS:
            if not self._table_part(name):
                return
        elif self.now.tag in IN_TABLE and name not in ("script", "style", "template", "input", "form"):
            table = self._table()
            if table is not None and table.up is not None and name != "table":
                node = Node(name, attrs, self.now)  # moved before the table; once it is closed, the table goes on
                kids = table.up.kids
                kids.insert(len(kids) - 1 - kids[::-1].index(table), node)
                if name not in VOID and not closed:
                    self.now = node
                return
            if name == "table":
                self._pop("table")
        self._push(name, attrs)
        if name in VOID or (closed and name not in BLOCK and name not in RAW):
            self.now = self.now.up or self.root

    def _table_part(self, name: str) -> bool:
        """Close and open what a part of a table implies; False if it stands in no table."""
        if self._open(("table",), ("html",)) is None:
            return False
        if name in ("td", "th"):
            if (node := self._open(("td", "th", "caption"), ("table",))) is not None:
                self.now = node.up or self.root
            if (node := self._open(("tr",), ("table",))) is not None:
                self.now = node
            else:
                self._table_part("tr")
                self._push("tr", {})
        elif name == "tr":
            if (node := self._open(("thead", "tbody", "tfoot"), ("table",))) is not None:
                self.now = node
            else:
                self.now = self._open(("table",), ("html",)) or self.root
                self._push("tbody", {})
        elif name == "col" and self._open(("colgroup",), ("table",)) is not None:
            pass
        else:
            self.now = self._open(("table",), ("html",)) or self.root
        return True

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return  # what follows still belongs to the body
        if name == "br":
            self.start("br", {}, False)
        elif name == "p":
            if not self._pop("p", SCOPE | {"button"}):
                self._push("p", {})
                self.now = self.now.up or self.root
        elif name in HEADINGS:
            if (node := self._open(HEADINGS, SCOPE)) is not None:
                self.now = node.up or self.root
        elif name == "li":
            self._pop("li", SCOPE | {"ul", "ol", "menu", "dir"})
        elif name in IN_TABLE or name == "caption":
            self._pop(name, ("html",) if name == "table" else ("html", "table"))
        elif name in ("td", "th"):
            self._pop(name, ("html", "table"))
        else:
            # an inline end tag does not close a block that was opened inside the inline element
            self._pop(name, SCOPE if name in BLOCK else SCOPE | BLOCK)


def visible(node: Node) -> bool:
    """Whether an element and all in it can be shown, as far as tag and attributes say; for visibility see shown()."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a:
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _NO_SHOW.search(a["style"]))


def shown(node: Node, inherited: bool) -> bool:
    """The visibility of an element: what its style says last, else that of the element around it."""
    found = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return found[-1].lower() == "visible" if found else inherited


class _Box:
    """Lines of text that blocks and inline text are written to."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines that are due before the next text
        self.space = False
        self.indent: list[str] = []
        self.mark = ""  # of a list item, for its first line

    def inline(self, text: str) -> None:
        lead = text[0] in " \t\n\f\r"
        body = _SPACES.sub(" ", text).strip(" ")
        if not body:
            self.space = self.space or bool(self.line)
            return
        if self.line and (lead or self.space):
            self.line.append(" ")
        self.line.append(body)
        self.space = text[-1] in " \t\n\f\r"

    def kept(self, text: str) -> None:
        """Preformatted text."""
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for part in rest:
            self.newline()
            self.line.append(part)
        self.space = False

    def newline(self) -> None:
        self._out("".join(self.line).rstrip())
        self.line, self.space = [], False

    def _out(self, text: str) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.indent)
        if self.mark and text:
            indent, self.mark = indent[: len(indent) - len(self.mark)] + self.mark, ""
        self.lines.append((indent + text).rstrip() if text else "")

    def block(self, gap: int) -> None:
        """The line ends here; at least `gap` blank lines follow."""
        if self.line and "".join(self.line).strip():
            self.newline()
        self.line, self.space = [], False
        if self.lines:
            self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.block(0)
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns spanned, rows spanned) as lines with padded columns."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}  # column: rows that a cell from above still covers
    for row in rows:
        placed: dict[int, tuple[list[str], int]] = {}
        col, covered = 0, dict(held)
        for lines, wide, tall in row:
            while covered.get(col, 0):
                col += 1
            placed[col] = (lines, wide)
            for c in range(col, col + wide):
                if tall > 1:
                    held[c] = tall
            col += wide
        grid.append(placed)
        held = {c: n - 1 for c, n in held.items() if n > 1}
    n = max((c + wide for row in grid for c, (_, wide) in row.items()), default=0)
    width = [0] * n
    for row in grid:
        for c, (lines, wide) in row.items():
            if wide == 1:
                width[c] = max(width[c], max(map(len, lines), default=0))
    for row in grid:  # a spanning cell that needs more widens its last column
        for c, (lines, wide) in row.items():
            have = sum(width[c : c + wide]) + 3 * (wide - 1)
            if wide > 1 and (need := max(map(len, lines), default=0)) > have:
                width[c + wide - 1] += need - have
    out = []
    for row in grid:
        for k in range(max((len(lines) for lines, _ in row.values()), default=0)):
            parts, c = [], 0
            while c < n:
                lines, wide = row.get(c, ([], 1))
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(width[c : c + wide]) + 3 * (wide - 1)))
                c += wide
            out.append(" | ".join(parts).rstrip(" |") if any(x.strip() for x in parts) else "")
    return [x for x in out if x]


def _span(value: str | None) -> int:
    m = re.match(r"\s*(\d+)", value or "")
    return min(max(1, int(m.group(1)[:4])), 1000) if m else 1


def render(root: Node) -> str:
    """The visible text under root. An explicit stack: depth is bounded by memory only."""
    boxes = [_Box()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[list] = []  # [next number or None for bullets, step]
    pre = 0
    seen = [True]  # the visibility of the open elements
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        box = boxes[-1]
        if isinstance(node, str):
            if node and seen[-1]:
                box.kept(node) if pre else box.inline(node)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node):
                continue
            if tag == "br":
                if box.line or box.lines:
                    box.newline()
                continue
            if tag == "hr":
                box.block(0)
                if shown(node, seen[-1]):
                    box.line.append("-" * 8)
                box.block(0)
                continue
            if tag == "input":
                if shown(node, seen[-1]) and node.attrs.get("type", "text").lower() in ("submit", "reset", "button", "text", "search", "email", "url", "tel", "number") and node.attrs.get("value"):
                    box.inline(" " + node.attrs["value"] + " ")
                continue
            if tag in VOID:
                continue
            seen.append(shown(node, seen[-1]))
            if tag in SPACED:
                box.space = box.space or bool(box.line)
            if tag in ("td", "th", "caption") and tables:
                boxes.append(_Box())
            elif tag == "table":
                box.block(1)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCK:
                box.block(1 if tag in MARGIN and not (lists and tag in ("ul", "ol", "menu")) else 0)
            if tag in ("ul", "menu", "dir"):
                lists.append([None, 0])
            elif tag == "ol":
                back = "reversed" in node.attrs
                items = sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)
                m = re.match(r"\s*(-?\d{1,9})", node.attrs.get("start", ""))
                lists.append([int(m.group(1)) if m else items if back else 1, -1 if back else 1])
            elif tag == "li":
                here = lists[-1] if lists else [None, 0]
                if here[0] is not None:
                    m = re.match(r"\s*(-?\d{1,9})", node.attrs.get("value", ""))
                    here[0] = int(m.group(1)) if m else here[0]
                box.mark = "- " if here[0] is None else f"{here[0]}. "
                if here[0] is not None:
                    here[0] += here[1]
                box.indent.append(" " * len(box.mark))
                if not seen[-1]:
                    box.mark = ""
            elif tag in ("blockquote", "dd"):
                box.indent.append("    ")
            elif tag in ("pre", "xmp", "plaintext", "textarea"):
                pre += 1
                if tag == "pre" and node.kids and isinstance(node.kids[0], str) and node.kids[0].startswith("\n"):
                    node.kids[0] = node.kids[0][1:]
            stack.append((node, True))
            kids = node.kids
            if tag == "select" and "multiple" not in node.attrs and _span(node.attrs.get("size")) == 1:
                kids = _chosen(node)
            elif tag == "optgroup" and seen[-1] and node.attrs.get("label", "").strip():
                box.inline(node.attrs["label"])
                box.block(0)
            elif tag == "details" and "open" not in node.attrs:
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"]
            stack.extend((k, False) for k in reversed(kids))
            continue
        seen.pop()
        if tag in SPACED:
            box.space = box.space or bool(box.line)
        if tag in ("td", "th") and tables:
            lines = boxes.pop().done()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, _span(node.attrs.get("colspan")), _span(node.attrs.get("rowspan"))))
        elif tag == "caption" and tables:
            lines = boxes.pop().done()
            for line in lines:
                boxes[-1].line.append(line)
                boxes[-1].block(0)
        elif tag == "table":
            box.block(0)
            for line in _aligned(tables.pop()):
                box.line.append(line)
                box.newline()
            box.block(1)
        elif tag in BLOCK:
            box.block(1 if tag in MARGIN and not (len(lists) > 1 and tag in ("ul", "ol", "menu")) else 0)
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("li", "blockquote", "dd"):
            box.indent.pop()
            if tag == "li":
                box.mark = ""
        elif tag in ("pre", "xmp", "plaintext", "textarea"):
            pre -= 1
    return "\n".join(boxes[0].done())


def _chosen(node: Node) -> list:
    """The option of a select that is shown."""
    options, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, Node):
            if k.tag == "option":
                options.append(k)
            else:
                todo.extend(reversed(k.kids))
    shown = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
    return [" ", *shown.kids, " "] if shown is not None else []


def extract(html: str | None) -> str | None:
    """The visible text of one page; null for null."""
    if html is None:
        return None
    return render(TreeBuilder().feed(html.replace("\x00", "")))


def page_texts(pages: DataFrame, html_col: str = "html", name: str = "visible_text") -> DataFrame:
    """pages without html_col, with the visible text of each page (under a fresh name where `name` is taken).

    Defined results: null gives null; an empty page, or one with nothing to see, gives an empty text; broken markup is
    read as the tree builder does, never refused; repeated rows give equal rows; other columns pass through.
    """
    rest = [c for c in pages.columns if c != html_col]
    plain = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(html_col).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(x.as_py()) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*b.schema.names[:-1], "text"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != "html"] + ["text string"])
    return plain.mapInArrow(work, schema).toDF(*rest, fresh_name(rest, name))


def fresh_name(taken: list[str], name: str) -> str:
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name

"""HTML to text as it would be seen: a tree builder with implied tags, visibility rules and block layout.

The tree builder closes what HTML closes by itself (paragraphs before blocks, list items, table cells and rows, options,
definition terms), ignores stray end tags and keeps void elements empty. Not visible are head, script, style, template,
noscript, form controls' values, comments, ``hidden``, ``display:none``, ``visibility:hidden`` (which a descendant may
undo with ``visibility:visible``), closed ``details`` but for their summary, frames', media's and selections' content, and
descriptions and definitions in ``svg`` and ``math``, whose texts are given. Blocks stand on lines of their own,
paragraphs and headings between blank lines; list items get a bullet or their number (``start``, ``value``, ``reversed``)
and are indented by depth; ``pre`` keeps its white space; ``br`` breaks a line; images give their alternative text. Table
cells of a row share a line, padded to their column's width (up to PAD characters) and parted by two spaces.

All visible text is given, whatever its length; nothing is scored or cut. Null html stays null, empty html gives ''.
Repeated rows get equal texts.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import append

PAD, MAX_OPEN = 40, 400
_words = str.split
VOID = frozenset(_words("area base br col embed hr img input link meta param source track wbr"))
BLOCK = frozenset(_words("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody tfoot thead tr ul caption td th"))
SPACED = frozenset(_words("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure hr menu dir"))
#: Inside svg and math these hold descriptions and definitions, which are not drawn.
UNDRAWN = frozenset(_words("desc metadata defs symbol clippath mask pattern lineargradient radialgradient marker filter annotation annotation-xml"))
UNSEEN = frozenset(_words("head script style template noscript title meta link base object iframe video audio canvas select textarea datalist option input button-value noframes rp param source track"))
RAW = frozenset(_words("script style textarea title noscript iframe noframes xmp"))
_CLOSES_P = frozenset(_words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul"))
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"caption", "colgroup", "tr", "td", "th", "tbody", "thead", "tfoot"}, "tbody": {"caption", "colgroup", "tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"caption", "colgroup", "tr", "td", "th", "tbody", "thead", "tfoot"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"}, "body": {"head"}}
_FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "rt": {"ruby"}, "rp": {"ruby"}, "body": {"html"}}
_BUTTON_SCOPE = frozenset(_words("table td th caption button object marquee html template"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_HEAD_ONLY = frozenset(_words("meta link base title style script noscript template"))
_TAG = re.compile(r"<(?:!--(?:>|->|(?P<c>.*?)(?:--!?>|\Z))|(?P<d>[!?][^>]*>?)|/(?P<e>[A-Za-z][^\s/>]*)[^>]*>?|(?P<s>[A-Za-z][^\s/>]*)(?P<a>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|/[^>]*>)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def parse(html: str) -> Node:
    """The element tree of a document or fragment.

    Its depth is bounded: of elements inside MAX_OPEN others only those that may hide or show what they hold become nodes;
    what other ones hold goes to the node around them.
    """
    root = Node("#root")
    stack = [root]
    at, n = 0, len(html)

    def close(tags: set[str], fence: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t in tags:
                del stack[i:]
                return
            if t in fence:
                return

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            stack[-1].kids.append(html[at:])
            break
        if lt > at:
            text = html[at:lt]
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].kids.append(text)
        m = _TAG.match(html, lt)
        if m is None:
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m["s"]:
            tag = m["s"].lower()
            attrs = {}
            if m["a"] and m["a"] != "/":
                for a in _ATTR.finditer(m["a"]):
                    attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
            if tag in ("html", "body") and any(x.tag == tag for x in stack):
                continue
            if stack[-1].tag == "head" and tag not in _HEAD_ONLY and tag != "head":
                stack.pop()
            if tag in _CLOSES_P:
                close({"p"}, _BUTTON_SCOPE)
            if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
                stack.pop()
            if tag in _CLOSED_BY:
                if tag in ("tr", "thead", "tbody", "tfoot"):
                    while any(x.tag in _CLOSED_BY[tag] for x in _upto(stack, _FENCE[tag])):
                        close(_CLOSED_BY[tag], _FENCE[tag])
                else:
                    close(_CLOSED_BY[tag], _FENCE[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].kids.append(row)
                stack.append(row)
            node = Node(tag, attrs)
            stack[-1].kids.append(node)
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                node.kids.append(html[at : end.start()] if end else html[at:])
                at = html.find(">", end.start()) + 1 if end else n
                at = at or n
            else:
                if len(stack) >= MAX_OPEN and not (tag in UNSEEN or tag in UNDRAWN or tag == "details" or "hidden" in attrs or "style" in attrs):
                    node.kids = stack[-1].kids
                    node.kids[-1:] = [Node("br")] if tag in BLOCK else []
                stack.append(node)
        elif m["e"]:
            tag = m["e"].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].kids.append(Node("p"))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i].tag
                    if t == tag or tag in _HEADINGS and t in _HEADINGS:
                        del stack[i:]
                        break
                    if t in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th"):
                        break
    return root


def _upto(stack: list[Node], fence: set[str]) -> list[Node]:
    out = []
    for x in reversed(stack):
        if x.tag in fence:
            break
        out.append(x)
    return out


class _Lines:
    """Lines under construction. ``gap``: blank lines owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.space = False

    def text(self, s: str) -> None:
        s = _BLANK.sub(" ", s)
        if not s or s == " ":
            self.space = self.space or bool(s and self.now)
            return
        if not self.now:
            s = s.lstrip(" ")
            self._open()
        elif self.space and s[0] != " ":
            s = " " + s
        self.space = s[-1] == " "
        self.now.append(s[:-1] if self.space else s)

    def _open(self) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0

    def end(self, gap: int = 0) -> None:
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str]) -> None:
        self.end()
        if lines:
            self._open()
            self.lines += lines


_HIDE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_ALPHA = "abcdefghijklmnopqrstuvwxyz"


def _label(kind: str, n: int) -> str:
    if kind in ("a", "A") and n > 0:
        out = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            out = _ALPHA[r] + out
        return (out if kind == "a" else out.upper()) + "."
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += s * (n // v)
            n %= v
        return (out if kind == "i" else out.upper()) + "."
    return f"{n}."


def _int(s: str | None) -> int | None:
    m = re.match(r"\s*([+-]?\d{1,9})", s or "")
    return int(m[1]) if m else None


def _render(node: Node, out: _Lines, shown: bool, pre: bool) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            if shown:
                text = unescape(kid) if "&" in kid else kid
                if pre:
                    for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                        if i:
                            if not out.now:
                                out._open()
                                out.now = [""]
                            out.end()
                        if part:
                            out._open() if not out.now else None
                            out.now.append(part.expandtabs(8))
                else:
                    out.text(text)
            continue
        tag, attrs = kid.tag, kid.attrs
        if tag in UNSEEN or "hidden" in attrs:
            continue
        seen = shown
        style = attrs.get("style")
        if style:
            if _HIDE.search(style):
                continue
            v = _VISIBILITY.findall(style)
            if v:
                seen = v[-1].lower() == "visible"
        if tag in ("svg", "math"):
            _drawn(kid)
        if tag == "br":
            if not out.now and seen:
                out._open()
                out.now = [""]
            out.end()
        elif tag == "img":
            if seen and attrs.get("alt"):
                out.text(attrs["alt"])
        elif tag == "hr":
            out.end(1)
        elif tag == "table":
            out.end(1)
            out.whole(_table(kid, seen))
            out.end(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            _list(kid, out, seen, pre)
        elif tag == "details" and "open" not in attrs:
            out.end()
            for x in kid.kids:
                if isinstance(x, Node) and x.tag == "summary":
                    _render(x, out, seen, pre)
                    break
            out.end()
        elif tag == "dd" or tag == "blockquote":
            inner = _Lines()
            _render(kid, inner, seen, pre)
            inner.end()
            gap = 1 if tag == "blockquote" else 0
            out.end(gap)
            out.whole([("    " + x if tag == "dd" else "> " + x).rstrip() for x in inner.lines])
            out.end(gap)
        elif tag in BLOCK:
            gap = 1 if tag in SPACED else 0
            out.end(gap)
            _render(kid, out, seen, pre or tag == "pre")
            out.end(gap)
        elif tag == "q":
            out.text("“")
            _render(kid, out, seen, pre)
            out.now.append("”") if seen and out.now else None
        else:
            _render(kid, out, seen, pre)


def _list(node: Node, out: _Lines, shown: bool, pre: bool) -> None:
    ordered = node.tag == "ol"
    items = [k for k in node.kids if isinstance(k, Node) and k.tag == "li"]
    step = -1 if ordered and "reversed" in node.attrs else 1
    start = _int(node.attrs.get("start"))
    n = start if start is not None else (len(items) if step < 0 else 1)
    out.end(1)
    for kid in node.kids:
        if not (isinstance(kid, Node) and kid.tag == "li"):
            holder = Node("div")
            holder.kids = [kid]
            _render(holder, out, shown, pre)
            continue
        if ordered:
            value = _int(kid.attrs.get("value"))
            n = value if value is not None else n
            mark = _label(kid.attrs.get("type") or node.attrs.get("type") or "1", n) + " "
            n += step
        else:
            mark = "- "
        inner = _Lines()
        holder = Node("div")
        holder.kids = [kid]
        kid.tag = "div"
        _render(holder, inner, shown, pre)
        inner.end()
        tight = [x for i, x in enumerate(inner.lines) if x or not _is_mark(inner.lines, i)]
        if tight:
            pad = " " * len(mark)
            out.whole([(mark if i == 0 else pad) + x if x else "" for i, x in enumerate(tight)])
    out.end(1)


def _is_mark(lines: list[str], i: int) -> bool:
    """Whether a blank line only parts an item's text from a list inside it."""
    return i + 1 < len(lines) and re.match(r"(?:- |\S{1,9}\. )", lines[i + 1]) is not None


def _drawn(node: Node) -> None:
    """Takes out of svg or math what is not drawn, at any depth, and parts svg's texts."""
    todo = [node]
    while todo:
        x = todo.pop()
        x.kids = [k for k in x.kids if isinstance(k, str) or k.tag not in UNDRAWN]
        if x.tag == "text":
            x.kids = [" ", *x.kids, " "]
        todo += [k for k in x.kids if isinstance(k, Node)]


def _parts(node: Node, shown: bool) -> tuple[list[tuple[Node, bool]], list[tuple[Node | str, bool]]]:
    """Rows and loose children of a table, each with whether it is shown.

    Sections hand on what they hold, and so does any other element around rows, such as a form.
    """
    rows, loose = [], []
    for k in node.kids:
        if isinstance(k, str):
            loose.append((k, shown))
        elif k.tag in UNSEEN or "hidden" in k.attrs or _HIDE.search(style := k.attrs.get("style", "")):
            continue
        elif k.tag == "tr" or k.tag in ("thead", "tbody", "tfoot", "colgroup", "col") or k.tag != "details" and _holds_rows(k):
            v = _VISIBILITY.findall(style)
            seen = v[-1].lower() == "visible" if v else shown
            if k.tag == "tr":
                rows.append((k, seen))
            else:
                inner = _parts(k, seen)
                rows += inner[0]
                loose += inner[1]
        else:
            loose.append((k, shown))
    return rows, loose


def _holds_rows(node: Node) -> bool:
    """Whether rows that belong to the table around node hang below it."""
    todo = [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, Node) and k.tag != "table":
                if k.tag == "tr":
                    return True
                todo.append(k)
    return False


def _table(node: Node, shown: bool) -> list[str]:
    """Lines of a table: caption, rows with aligned cells, and text that stands between them."""
    loose = _Lines()
    rows, between = _parts(node, shown)
    for k, seen in between:
        holder = Node("div")
        holder.kids = [k]
        _render(holder, loose, seen, False)
    loose.end()
    grid: list[list[list[str]]] = []
    for row, seen in rows:
        cells: list[list[str]] = []
        for k in row.kids:
            inner = _Lines()
            holder = Node("div")
            if isinstance(k, Node) and k.tag in ("td", "th"):
                if "hidden" in k.attrs or _HIDE.search(k.attrs.get("style", "")):
                    continue
                holder.kids, holder.attrs, tag = [k], {}, k.tag
                k.tag = "div"
                _render(holder, inner, seen, False)
                k.tag = tag
                inner.end()
                cells.append([x for x in inner.lines if x])
                cells += [[] for _ in range(min(100, (_int(k.attrs.get("colspan")) or 1) - 1))]
            else:
                holder.kids = [k]
                _render(holder, inner, seen, False)
                inner.end()
                if inner.lines:
                    cells.append([x for x in inner.lines if x])
        if any(cells):
            grid.append(cells)
    width: list[int] = []
    for cells in grid:
        for i, c in enumerate(cells):
            if i == len(width):
                width.append(0)
            width[i] = max(width[i], *(len(x) for x in c if len(x) <= PAD), 0)
    lines = loose.lines
    for cells in grid:
        for j in range(max(len(c) for c in cells)):
            lines.append("  ".join((c[j] if j < len(c) else "").ljust(width[i]) for i, c in enumerate(cells)).rstrip())
    return lines


def render(html: str) -> str:
    """All visible text of a page."""
    out = _Lines()
    _render(parse(html), out, True, False)
    out.end()
    return "\n".join(x.rstrip() for x in out.lines).strip("\n")


def extract(pages: DataFrame, *, html: str = "html", into: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages with the visible text of their html."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        col = batch.column(batch.schema.get_field_index(html))
        return [pa.array([None if h is None else render(h) for h in col.to_pylist()], pa.string())]

    return append(pages.withColumn(html, F.col(html).cast("string")), T.StructType([T.StructField(into, T.StringType())]), compute, keep)

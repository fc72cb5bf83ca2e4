"""HTML extraction by layout-aware rendering: all visible text, laid out as blocks, lists and tables.

A tolerant scanner feeds a tree builder that supplies implied end tags (paragraphs, list items, table
cells and rows, options) and ignores stray ones. What a browser doesn't show is dropped: scripts,
styles, templates, frames and media, elements with ``hidden``, ``display:none`` or
``visibility:hidden``. The renderer collapses white space, sets blocks apart by a newline and
paragraph-like ones by a blank line, marks list items, keeps preformatted text, and pads the cells of
a table's columns to one width (cells over ``WIDEST`` characters stand as they are). What a table holds
outside its cells stands on lines of its own, between the rows where it was found. A select shows its
chosen option, a list of several choices all of them.

A page takes time in proportion to its length, whatever it holds: tags that never end are looked
through once, open elements are found by their tag, and neither depth nor length has a limit.

Defined cases: null html gives null text; an empty page an empty text; an open head ends at the first
tag or text that doesn't belong in it; unclosed or unopened tags, stray ``<`` and unknown entities
stand as text; tables more than ``TABLE_LEVELS`` deep in tables keep their text as blocks; repeated rows
are rendered alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.text import chunks, walk

#: Start of a token: a comment, another declaration, or a tag's name.
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: What ends a tag or opens a value in it.
_MARK = re.compile(r"[>\"']")
#: The rest of a tag that is short and has its quotes in pairs: nearly all of them.
_SHORT = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NEAR = 256
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template")}
#: A name with its value, or a stray quoted string.
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"']+))?|"[^"]*"|'[^']*'""")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_CSS_MARK = re.compile(r"/\*|[\"'();]")
_CSS_HIDES = re.compile(r"\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?", re.I)
_START = re.compile(r"""(?:^|\s)start\s*=\s*["']?(-?\d{1,9})""", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = frozenset("head script style template noscript title iframe object svg canvas datalist audio video".split())
BLOCKS = frozenset("address article aside body center dd details div dl dt fieldset figcaption figure footer form header hgroup html legend li main nav ol section summary table tr ul".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base head html link meta noframes noscript script style template title".split())
SPACED = frozenset("blockquote h1 h2 h3 h4 h5 h6 hr p pre".split())
#: For a start tag: the open elements it ends, and those that it doesn't look past.
_CLOSERS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
_ENDS_P = BLOCKS | SPACED
_P_LIMITS = frozenset(("table", "td", "th", "li", "div", "section", "article", "body", "button", "caption", "blockquote"))
#: Tables in tables are laid out down to this depth; below it their texts are blocks.
TABLE_LEVELS = 16
#: Lists in lists are set in further down to this depth.
MOST_INDENTS = 16
#: Longer cells stand as they are and don't widen their column.
WIDEST = 200


class Node:
    __slots__ = ("children", "start", "tag")

    def __init__(self, tag: str, start: int = 1) -> None:
        self.tag, self.start = tag, start
        self.children: list[Node | str] = []


def _attributes(written: str) -> dict[str, str]:
    """Names and values of a tag; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(written):
        if m[1]:
            value = m[2] or ""
            found.setdefault(m[1].lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def _declarations(style: str) -> Iterator[str]:
    """The declarations of a style, with comments, strings and what stands in brackets left out."""
    kept: list[str] = []
    at = open_ = 0
    while m := _CSS_MARK.search(style, at):
        if not open_:
            kept.append(style[at : m.start()])
        at = m.end()
        if m[0] in ("/*", '"', "'"):
            end = style.find("*/" if m[0] == "/*" else m[0], at)
            kept.append(" ")
            at = len(style) if end < 0 else end + (2 if m[0] == "/*" else 1)
        elif m[0] == "(":
            open_ += 1
        elif m[0] == ")":
            open_ = max(0, open_ - 1)
            kept.append(" ")
        elif not open_:
            yield "".join(kept)
            kept.clear()
    if not open_:
        kept.append(style[at:])
    yield "".join(kept)


def _hides(written: str) -> bool:
    """Whether a tag's attributes hide it: ``hidden``, or a declaration of its style."""
    if not _MAY_HIDE.search(written):
        return False
    found = _attributes(written)
    return "hidden" in found or any(_CSS_HIDES.fullmatch(d) for d in _declarations(found.get("style", "")))


class _TagEnds:
    """Where tags end: at the first ``>`` outside quotes. A page is walked once, however many tags
    in it are never closed: what lies behind a mark is found out once for each mark."""

    def __init__(self, html: str) -> None:
        self.html, self.known = html, {}
        self.last = html.rfind(">")

    def of(self, at: int) -> int:
        """The place of the ``>``, or -1."""
        if at > self.last:
            return -1
        if m := _SHORT.match(self.html, at, at + _NEAR):
            return m.end() - 1
        html, known, passed = self.html, self.known, []
        while True:
            m = _MARK.search(html, at)
            if not m:
                found = -1
                break
            at = m.start()
            if at in known:
                found = known[at]
                break
            passed.append(at)
            if m[0] == ">":
                found = at
                break
            close = html.find(m[0], at + 1)
            if close < 0:
                found = -1
                break
            at = close + 1
        known.update(dict.fromkeys(passed, found))
        return found


class _Stack:
    """The open elements, and for each tag the depths where it is open."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at = [root], {}
        #: depth of the outermost hidden element, or 0
        self.hidden = 0

    def push(self, node: Node, hides: bool) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)
        if hides and not self.hidden:
            self.hidden = len(self.nodes) - 1

    def close_to(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.at[self.nodes.pop().tag].pop()
        if depth <= self.hidden:
            self.hidden = 0

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of the tag, or 0."""
        depths = self.at.get(tag)
        return depths[-1] if depths else 0

    def find(self, tags: Iterable[str], limits: Iterable[str]) -> int:
        """Depth of the outermost of the tags' open elements above the nearest limit, or 0."""
        floor = max((self.last(t) for t in limits), default=0)
        found = [d[k] for t in tags if (d := self.at.get(t)) and (k := bisect_right(d, floor)) < len(d)]
        return min(found, default=0)


_BARRIERS = ("table", "td", "th")
_PAST_BARRIERS = frozenset("table tr thead tbody tfoot body html".split())


def parse(html: str) -> Node:
    """The tree of visible elements and texts."""
    root = Node("root")
    stack, ends, at, done = _Stack(root), _TagEnds(html), 0, 0

    def text(s: str) -> None:
        if stack.nodes[-1].tag == "head" and s.strip(" \t\n\r\f"):
            stack.close_to(len(stack.nodes) - 1)
        if s and not stack.hidden:
            stack.nodes[-1].children.append(unescape(s) if "&" in s else s)

    # ``done`` is where text begins that hasn't been handed on yet
    while m := _OPEN.search(html, at):
        start, at = m.start(), m.end()
        if m[1]:
            end = html.find("-->", start + 2)
            end = len(html) if end < 0 else end + 3
        else:
            end = ends.of(at) if m[4] else html.find(">", at, ends.last + 1) if at <= ends.last else -1
            if end < 0:
                continue
            end += 1
        text(html[done:start])
        written, at = html[m.end() : end - 1], end
        done = end
        if not m[4]:
            continue
        tag = m[4].lower()
        if m[3]:
            depth = stack.last(tag)
            if depth and (tag in _PAST_BARRIERS or depth >= max(stack.last(b) for b in _BARRIERS)):
                stack.close_to(depth)
            continue
        if tag in _CLOSERS and (d := stack.find(*_CLOSERS[tag])):
            stack.close_to(d)
        elif tag in _ENDS_P and (d := stack.find(("p",), _P_LIMITS)):
            stack.close_to(d)
        if tag == "body" and (d := stack.find(("head",), ())):
            stack.close_to(d)
        if stack.nodes[-1].tag == "head":
            if tag in ("head", "html"):
                continue
            if tag not in IN_HEAD:
                stack.close_to(len(stack.nodes) - 1)
        if tag in VOID:
            if not stack.hidden:
                stack.nodes[-1].children.append(Node(tag))
            continue
        gone = tag in NEVER_SHOWN or bool(written and _hides(written))
        if tag in _RAW_END:
            close = _RAW_END[tag].search(html, at, ends.last + 1)
            if tag == "textarea" and not gone:
                text(html[at : close.start() if close else len(html)])
            at = done = close.end() if close else len(html)
            continue
        node = Node(tag, int(s[1]) if tag == "ol" and (s := _START.search(written)) else 1)
        if tag == "option" and _chosen(written):
            node.start = 2
        elif tag == "select" and _open_list(written):
            node.start = 2
        if not stack.hidden and not gone:
            stack.nodes[-1].children.append(node)
        stack.push(node, gone)
    text(html[done:])
    return root


def _chosen(written: str) -> bool:
    return "selected" in _attributes(written)


def _open_list(written: str) -> bool:
    """Whether a select shows all its options: a list of several lines or choices."""
    found = _attributes(written)
    return "multiple" in found or found.get("size", "").strip() not in ("", "0", "1")


def _options(select: Node) -> list[Node]:
    """What a select shows: all options if it is a list, else the last that is chosen, or the first."""
    found, waiting = [], [select]
    while waiting:
        n = waiting.pop()
        if n.tag == "option":
            found.append(n)
        else:
            waiting += [c for c in reversed(n.children) if isinstance(c, Node)]
    if select.start == 2 or not found:
        return found
    return ([n for n in found if n.start == 2] or found[:1])[-1:]


class _Out:
    """Text with pending breaks: lines end once, blank lines never double, white space collapses."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.indent = 0, False, ""

    def block(self, n: int) -> None:
        if self.parts:
            self.breaks = max(self.breaks, n)
        self.space = False

    def put(self, s: str) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks + self.indent)
            self.breaks = 0
        elif not self.parts and self.indent:
            self.parts.append(self.indent)
        elif self.space and self.parts:
            self.parts.append(" ")
        self.space = False
        self.parts.append(s)

    def text(self, s: str) -> None:
        if not s:
            return
        body = _SPACE.sub(" ", s)
        if body[0] == " ":
            self.space = self.space or bool(self.parts)
        inner = body.strip(" ")
        if inner:
            self.put(inner)
            self.space = body[-1] == " "

    def done(self) -> str:
        return "".join(self.parts)


def _parts(table: Node) -> list[tuple[bool, list]]:
    """In order, (True, cells) of each row of the table itself, and (False, nodes) of what stands outside cells."""
    order: list[tuple[Node, Node]] = []
    seen = [(table, table)]
    while seen:
        n, parent = seen.pop()
        order.append((n, parent))
        if n is table or n.tag not in ("table", "td", "th"):
            seen += [(c, n) for c in n.children if isinstance(c, Node)]
    holders: set[Node] = set()
    for n, parent in reversed(order):
        if n.tag in ("tr", "td", "th") or n in holders:
            holders.add(parent)
    parts: list[tuple[bool, list]] = []

    def place(row: list[Node] | None) -> int:
        """What a row holds before its first cell stands before the row."""
        at = len(parts)
        if row is not None and not row:
            at -= 1
            while parts[at][1] is not row:
                at -= 1
        return at

    def stray(n: Node | str, row: list[Node] | None) -> None:
        at = place(row)
        if not at or parts[at - 1][0]:
            parts.insert(at, (False, []))
            at += 1
        parts[at - 1][1].append(n)

    #: nodes, each with the row that it is in; no node: the end of a block
    waiting: list = [(c, None) for c in reversed(table.children) if isinstance(c, str) or c.tag != "caption"]
    while waiting:
        n, row = waiting.pop()
        if n is None:
            parts.insert(place(row), (False, []))
        elif isinstance(n, str):
            stray(n, row)
        elif n.tag == "tr":
            cells: list[Node] = []
            parts += [(False, []), (True, cells)]
            waiting.append((None, cells))
            waiting += [(c, cells) for c in reversed(n.children)]
        elif n.tag in ("td", "th"):
            if row is None:
                parts.append((True, [n]))
            else:
                row.append(n)
        elif n in holders and n.tag != "table":
            if n.tag in _ENDS_P:
                parts.insert(place(row), (False, []))
                waiting.append((None, row))
            waiting += [(c, row) for c in reversed(n.children)]
        else:
            stray(n, row)
    return parts


def _table(node: Node, out: _Out, level: int) -> None:
    parts: list[tuple[bool, list[str]]] = []
    for row, held in _parts(node):
        if row:
            parts.append((True, [_SPACE.sub(" ", render(c, level + 1)) for c in held]))
        elif held:
            outside = Node("div")
            outside.children = held
            parts.append((False, [render(outside, level + 1)]))
    grid = [cells for row, cells in parts if row]
    widths = [0] * max(map(len, grid), default=0)
    for cells in grid:
        for k, c in enumerate(cells):
            if widths[k] < len(c) <= WIDEST:
                widths[k] = len(c)
    for row, cells in parts:
        if row:
            line = " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=False)).rstrip()
            shown = line.strip(" |")
        else:
            line = shown = cells[0].replace("\n", "\n" + out.indent)
        if shown:
            out.block(1)
            out.put(line)
    out.block(1)


def _indent(lists: list[list]) -> str:
    return "  " * min(max(0, len(lists) - 1), MOST_INDENTS)


def render(root: Node, level: int = 0) -> str:
    """The visible text of a subtree."""
    out = _Out()
    #: what is left to do: a node or text, or a function to call on leaving an element
    work: list = [root]
    lists: list[list] = []
    pre = 0

    def leave(tag: str, breaks: int):
        def act() -> None:
            nonlocal pre
            if tag in ("ul", "ol"):
                lists.pop()
                out.indent = _indent(lists)
            if tag == "pre":
                pre -= 1
            if breaks:
                out.block(breaks)

        return act

    while work:
        x = work.pop()
        if callable(x):
            x()
        elif isinstance(x, str):
            if pre:
                for k, line in enumerate(x.split("\n")):
                    if k:
                        out.parts.append("\n" + out.indent)
                    if line:
                        out.put(line)
            else:
                out.text(x)
        elif x.tag == "br":
            if out.parts:
                out.breaks = min(2, out.breaks + 1)
            out.space = False
        elif x.tag == "select":
            for k, option in enumerate(_options(x)):
                if k:
                    out.block(1)
                out.text(" ")
                out.text(render(option, level))
                out.text(" ")
        elif x.tag == "table" and x is not root and level < TABLE_LEVELS:
            out.block(2)
            for c in x.children:
                if isinstance(c, Node) and c.tag == "caption":
                    out.put(render(c, level + 1))
                    out.block(1)
            _table(x, out, level)
            out.block(2)
        else:
            inside = x is root and x.tag in ("td", "th", "caption", "table")
            breaks = 0 if inside else 2 if x.tag in SPACED or x.tag in ("ul", "ol") and not lists else 1 if x.tag in BLOCKS else 0
            if breaks:
                out.block(breaks)
            if x.tag in ("ul", "ol"):
                lists.append([x.tag, x.start])
                out.indent = _indent(lists)
            elif x.tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                out.put(f"{kind[1]}. " if kind[0] == "ol" else "- ")
                kind[1] += 1
            elif x.tag == "pre":
                pre += 1
            work.append(leave(x.tag, breaks))
            work += reversed(x.children)
    return out.done().strip("\n")


def page_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and text of every page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, html_col):
            texts = [page_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return walk(pages.select(id_col, html_col), run, f"`{id_col}` {kind}, text string")

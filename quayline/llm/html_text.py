"""Visible text of HTML pages by layout: a tree with implied tags, visibility rules, and a rendering in lines.

The tree builder closes elements that another start tag ends (paragraphs, list items, cells, rows, options), keeps
raw text out of the tree, and lets end tags without a start pass. What a browser does not show is left out: the
head, scripts, templates and the like, what the hidden attribute, a style attribute or the page's own style sheets
take off the screen (display) or hide (visibility, which an element inside can undo), and closed details but for
their summary. Style rules count if they hold on every screen and their selectors are made of tags, classes and ids,
with descendants and children; the more specific rule wins, then the later one. Images count by their alt text,
inputs by their values.

Blocks begin on lines of their own, with a blank line around those that have margins; list items are marked and
indented, by INDENT columns at most. Cells of a table are padded to columns, its first head first and its first foot
last; a cell's text is wrapped at WRAP columns, as its neighbours' is, and a longer word sticks out. Wide letters
count as two columns. Preformatted text keeps blanks.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, column, pieces

#: Columns at which a table's cell is wrapped, and that lines are indented by at most.
WRAP, INDENT = 80, 80

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas svg datalist noembed noframes title rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div li dt dd tr thead tbody tfoot caption td th section article aside nav header footer main address form details summary figcaption option optgroup center search hgroup legend".split())
#: A start tag, the open elements that it ends, and those beyond which it doesn't look.
_ROW = ("td", "th", "tr", "caption", "colgroup")
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th caption colgroup".split()), frozenset("tr table".split())),
    "th": (frozenset("td th caption colgroup".split()), frozenset("tr table".split())),
    "tr": (frozenset(_ROW), frozenset(["table"])),
    "thead": (frozenset((*_ROW, "thead", "tbody", "tfoot")), frozenset(["table"])),
    "tbody": (frozenset((*_ROW, "thead", "tbody", "tfoot")), frozenset(["table"])),
    "tfoot": (frozenset((*_ROW, "thead", "tbody", "tfoot")), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "a": (frozenset(["a"]), frozenset("td th table".split())),
    "body": (frozenset(["head"]), frozenset()),
}
_GRID = frozenset("tr td th thead tbody tfoot".split())
_P_SCOPE = frozenset("button td th caption table object".split())
_END_SCOPE = frozenset("table td th caption".split())
_P_ENDERS = SPACED | frozenset("div section article aside nav header footer main address form details center figcaption li dt dd".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_CSS_SKIPPED = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", re.S)
_CSS_MARK = re.compile(r"[{};]")
_CSS_NESTED = re.compile(r"[^;{}]*\{[^{}]*\}")
_SCREEN = frozenset(["all", "screen", "only all", "only screen"])
_DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = field(default=None, repr=False, compare=False)
    shown: bool | None = None  # whether it is visible, once known


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw.strip() else {}


class _Stack(list):
    """The open elements, and how many there are of each tag."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.open: Counter[str] = Counter()
        self.deepest = 1

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] += 1
        self.deepest = max(self.deepest, len(self))

    def drop(self, start: int) -> None:
        for node in self[start:]:
            self.open[node.tag] -= 1
        del self[start:]

    def close(self, ends: frozenset[str], scope: frozenset[str]) -> None:
        """Takes elements off through the outermost of ends that scope doesn't cover."""
        if not any(self.open[t] for t in ends):
            return
        for i in range(len(self) - 1, 0, -1):
            if self[i].tag in scope:
                break
            if self[i].tag in ends:
                self.drop(i)


def _tag_end(page: str, at: int) -> int:
    """Where a tag's > is, quotes minded if they are closed; -1 if there is none."""
    i = at
    while True:
        i = _PLAIN.match(page, i).end()
        if i >= len(page):
            return page.find(">", at)
        if page[i] == ">":
            return i
        i = page.find(page[i], i + 1) + 1
        if not i:
            return page.find(">", at)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): text, start and end tags, and the raw text of elements that have it."""
    at, found = 0, 0
    while at < len(page):
        found = page.find("<", found)
        name = _NAME.match(page, found + 1) if found >= 0 else None
        mark = page[found + 1 : found + 2] if found >= 0 else ""
        if found >= 0 and name is None and mark not in ("!", "?"):
            found += 1
            continue
        if page.startswith("<!--", found):
            stop = page.find("-->", found + 4)
            stop = len(page) if stop < 0 else stop + 2
        else:
            stop = -1 if found < 0 else _tag_end(page, name.end()) if name else page.find(">", found)
        if stop < 0:  # no tag ends any more: all the rest is text
            yield "text", page[at:], ""
            return
        if found > at:
            yield "text", page[at:found], ""
        at = found = stop + 1
        if name:
            tag = name[1].lower()
            if page[name.start()] == "/":
                yield "end", tag, ""
                continue
            yield "start", tag, page[name.end() : stop]
            if tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                yield "raw", page[at : shut.start() if shut else len(page)], ""
                at = found = shut.start() if shut else len(page)


def parse(page: str) -> tuple[Node, list[str], int]:
    """The tree of a page, the texts of its style sheets for screens, and how deep it is."""
    root, styles = Node("#root"), []
    stack = _Stack(root)

    def start(tag: str, attributes: dict[str, str]) -> None:
        if tag in _P_ENDERS:
            stack.close(frozenset(["p"]), _P_SCOPE)
        if tag in ENDS:
            stack.close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            start("tr", {})
        node = Node(tag, attributes, parent=stack[-1])
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.push(node)

    def end(tag: str) -> None:
        if tag == "br":
            stack[-1].children.append(Node("br", parent=stack[-1]))
        elif stack.open[tag]:
            scope = _END_SCOPE if tag not in _END_SCOPE | {"tr", "thead", "tbody", "tfoot"} else frozenset(["table"]) - {tag}
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag or stack[i].tag in scope), 0)
            if i and stack[i].tag == tag:
                stack.drop(i)

    opened, media = "", ""
    for kind, what, attributes in _tokens(page):
        if kind == "text":
            stack[-1].children.append(html.unescape(what))
        elif kind == "start":
            opened, own = what, _attributes(attributes)
            media = own.get("media", "")
            start(what, own)
        elif kind == "end":
            end(what)
        elif opened == "style":
            if _on_screen(media):
                styles.append(what)
        elif opened in ("textarea", "title", "xmp"):
            stack[-1].children.append(what if opened == "xmp" else html.unescape(what))
    return root, styles, stack.deepest


def _on_screen(media: str) -> bool:
    """Whether a list of media queries holds on every screen; one with a condition on its size or the like doesn't count."""
    return not media.strip() or any(" ".join(q.lower().split()) in _SCREEN for q in media.split(","))


def _css_blocks(css: str) -> Iterator[tuple[str, str]]:
    """(what stands before, what is in) the outer blocks of a style sheet without comments and strings."""
    depth, start, opened = 0, 0, 0
    for m in _CSS_MARK.finditer(css):
        if m[0] == "{":
            if not depth:
                opened = m.start()
            depth += 1
        elif m[0] == "}":
            depth = max(depth - 1, 0)
            if not depth:
                if opened >= start:
                    yield css[start:opened].strip(), css[opened + 1 : m.start()]
                start, opened = m.end(), -1
        elif not depth:
            start, opened = m.end(), -1
    if depth:
        yield css[start:opened].strip(), css[opened + 1 :]


def _declared(text: str) -> dict[str, tuple[bool, str]]:
    """Display and visibility as declarations set them, and whether they are important."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _DECLARED.findall(text):
        if important or not out.get(name.lower(), (False,))[0]:
            out[name.lower()] = bool(important), value.lower()
    return out


@dataclass(frozen=True)
class _Step:
    """One element of a selector: tag, ids, classes, and whether the step before it is its parent or any ancestor."""

    tag: str
    names: frozenset[str]
    child: bool

    def fits(self, node: Node) -> bool:
        a = node.attributes
        own = {f".{c}" for c in a.get("class", "").split()} | {f"#{a.get('id')}"} if self.names else frozenset()
        return self.tag in ("*", node.tag) and self.names <= own


def _selector(text: str) -> list[_Step] | None:
    """A selector's steps, the last first; None if it is made of other things than tags, classes, ids, descendants and children."""
    steps, child = [], False
    for part in text.replace(">", " > ").split():
        m = _COMPOUND.fullmatch(part)
        if part == ">":
            child = True
        elif m is None:
            return None
        else:
            steps.append(_Step((m[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", m[2])), child))
            child = False
    return steps[::-1] if steps and not child else None


class _Selector:
    """A selector's steps, the last first, and what is known of the nodes that were looked at: each node is looked at once.

    Of a node it is kept, as bits, which steps fit it with all that they ask of the nodes above it, and which ones fit it
    or a node above it.
    """

    def __init__(self, steps: list[_Step]) -> None:
        self.steps, self.known = steps, {}

    def matches(self, node: Node) -> bool:
        todo, at = [], node
        while at is not None and id(at) not in self.known:
            todo.append(at)
            at = at.parent
        own, near = self.known[id(at)] if at is not None else (0, 0)
        for at in reversed(todo):
            fits = 0
            for i, step in enumerate(self.steps):
                above = i + 1 == len(self.steps) or (own if step.child else near) >> (i + 1) & 1
                if above and step.fits(at):
                    fits |= 1 << i
            own, near = fits, near | fits
            self.known[id(at)] = own, near
        return bool(own & 1)


class Rules:
    """The display and visibility rules of style sheets that hold on every screen; others are passed over."""

    def __init__(self, sheets: list[str]) -> None:
        self.by: dict[str, list[tuple[tuple[int, int, int], int, _Selector, dict[str, tuple[bool, str]]]]] = {}
        n = 0
        for sheet in sheets:
            todo = [_CSS_SKIPPED.sub(lambda m: '""' if m[1] else " ", sheet)]
            while todo:
                inner = []
                for before, inside in _css_blocks(todo.pop()):
                    if before.startswith("@"):
                        at = re.fullmatch(r"@(media|layer)\b(.*)", before, re.S | re.I)
                        if at and (at[1].lower() == "layer" or _on_screen(at[2])):
                            inner.append(inside)
                        continue
                    while (own := _CSS_NESTED.sub("", inside)) != inside:
                        inside = own
                    if not (set_ := _declared(inside)):
                        continue
                    for one in before.split(","):
                        if steps := _selector(one):
                            n += 1
                            weight = tuple(sum(sum(x[0] == mark for x in s.names) for s in steps) for mark in "#.") + (sum(s.tag != "*" for s in steps),)
                            self.by.setdefault(min(steps[0].names, default=steps[0].tag), []).append((weight, n, _Selector(steps), set_))
                todo += inner[::-1]

    def of(self, node: Node) -> dict[str, str]:
        """Display and visibility as they are set for a node itself."""
        a, best = node.attributes, {}
        inline = _declared(a["style"]) if "style" in a else {}
        found = [((1, 0, 0, 0), 0, inline)] if inline else []
        if self.by:
            for key in {"*", node.tag, f"#{a.get('id')}", *(f".{c}" for c in a.get("class", "").split())}:
                found += [((0, *weight), n, set_) for weight, n, selector, set_ in self.by.get(key, ()) if selector.matches(node)]
        for weight, n, set_ in found:
            for name, (important, value) in set_.items():
                if name not in best or (important, weight, n) > best[name][0]:
                    best[name] = (important, weight, n), value
        return {name: value for name, (_, value) in best.items()}


def seen(node: Node, rules: Rules) -> bool:
    """Whether a node is on the screen at all; shown tells whether what is directly in it is visible."""
    if node.shown is None:
        own = rules.of(node)
        node.shown = own["visibility"] not in ("hidden", "collapse") if own.get("visibility", "inherit") != "inherit" else node.parent is None or node.parent.shown is not False
        if node.tag in UNSEEN or (own["display"] == "none" if "display" in own else "hidden" in node.attributes):
            node.tag = "#unseen"
    return node.tag != "#unseen"


def _width(text: str) -> int:
    """Columns of a text: wide letters take two, marks on other letters none."""
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def _wrapped(text: str) -> list[str]:
    """The lines of a cell, those of more than WRAP columns broken at blanks."""
    out = []
    for line in text.split("\n"):
        if _width(line) <= WRAP:
            out.append(line)
            continue
        now, n = [], 0
        for word in line.split(" "):
            w = _width(word)
            if now and n + 1 + w > WRAP:
                out.append(" ".join(now))
                now, n = [], 0
            n += w + (1 if now else 0)
            now.append(word)
        out.append(" ".join(now))
    return out


class _Lines:
    """Lines that are being written: text collapses its blanks, blocks break lines, margins become one blank line."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.margin = False
        self.indent, self.marker = "", ""

    def text(self, text: str, kept: bool) -> None:
        if kept:
            first, *rest = text.split("\n")
            self.now.append(first)
            for line in rest:
                self.line(True)
                self.now.append(line)
            return
        text = _BLANKS.sub(" ", text)
        if not self.now or self.now[-1].endswith(" "):
            text = text.removeprefix(" ")
        if text:
            self.now.append(text)

    def line(self, forced: bool = False) -> None:
        text = "".join(self.now).replace("\xa0", " ").rstrip()
        self.now = []
        if text or (forced and self.done):
            if self.margin and self.done and self.done[-1]:
                self.done.append("")
            self.margin = False
            lead = self.indent[: min(len(self.indent) - len(self.marker), INDENT)] + self.marker if self.marker else self.indent[:INDENT]
            self.done.append((lead + text).rstrip())
            self.marker = ""

    def block(self, spaced: bool) -> None:
        self.line()
        self.margin |= spaced


def _holders(table: Node) -> set[int]:
    """The elements (by id) between a table and its cells that hold rows or cells of it."""
    nodes, holds = [(table, 0)], [False]
    for i, (node, _) in enumerate(nodes):
        for c in node.children if node.tag not in ("td", "th") and (node.tag != "table" or not i) else ():
            if isinstance(c, Node):
                nodes.append((c, i))
                holds.append(False)
    for i in range(len(nodes) - 1, 0, -1):
        node, above = nodes[i]
        holds[above] |= holds[i] or node.tag in _GRID
    return {id(node) for (node, _), held in zip(nodes, holds, strict=True) if held}


@dataclass
class _Row:
    """A row's cells, and which group it belongs to: its element's kind and number."""

    group: tuple[str, int]
    cells: list[Node] = field(default_factory=list)


def _grid(node: Node, rules: Rules, holders: set[int], rows: list[_Row], row: _Row | None = None, group: tuple[str, int] = ("", 0)) -> list[Node | str]:
    """Adds the rows below a table, with their groups, to rows; returns what is misplaced around the cells.

    Elements such as forms that stand between a table and its cells are looked through. Nested tables are not.
    """
    loose: list[Node | str] = []
    for c in node.children:
        if isinstance(c, str):
            loose.append(c if node.shown is not False else "")
        elif not seen(c, rules):
            continue
        elif c.tag in ("td", "th"):
            if row is None:
                rows.append(row := _Row(group))
            row.cells.append(c)
        elif c.tag == "tr":
            rows.append(new := _Row(group))
            loose += _grid(c, rules, holders, rows, new, group)
        elif c.tag in _GRID:
            loose += _grid(c, rules, holders, rows, None, (c.tag, id(c)))
        elif id(c) in holders:
            rest = _grid(c, rules, holders, rows, row, group)
            if [x for x in rest if isinstance(x, Node) or x.strip()]:
                loose.append(Node(c.tag, c.attributes, rest, c.parent, c.shown))
        else:
            loose.append(c)
    return loose


def _in_order(rows: list[_Row]) -> list[_Row]:
    """Rows with the first head at the top and the first foot at the bottom."""
    first = {kind: next((r.group for r in rows if r.group[0] == kind), None) for kind in ("thead", "tfoot")}
    return sorted(rows, key=lambda r: 0 if r.group == first["thead"] else 2 if r.group == first["tfoot"] else 1)


def _span(cell: Node, name: str) -> int:
    """A cell's colspan (up to 1000) or rowspan (up to 65534), as browsers read them; a rowspan of 0 reaches to the end of its group."""
    n = re.match(r"\s*(\d{1,9})", cell.attributes.get(name, ""))
    least, most = (0, 65_534) if name == "rowspan" else (1, 1000)
    return max(least, min(int(n[1]), most)) if n else 1


def _table(out: _Lines, table: Node, rules: Rules) -> None:
    rows: list[_Row] = []
    for c in _grid(table, rules, _holders(table), rows):  # captions, and what is misplaced around cells
        if not isinstance(c, Node):
            out.text(c, False)
        else:
            out.block(False)
            _render(out, c, rules, False)
    out.block(False)
    placed: list[list[tuple[int, int, list[str]]]] = []
    widths: dict[int, int] = {}
    taken: dict[int, float] = {}  # columns that a cell from above reaches into, and for how many rows
    last = None
    for row in _in_order(rows):
        if row.group != last:
            taken, last = {}, row.group
        new, at = {}, 0
        placed.append([])
        for cell in row.cells:
            while at in taken:
                at += 1
            span, down = _span(cell, "colspan"), _span(cell, "rowspan") or float("inf")
            lines = _wrapped(render(cell, rules))
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(max(map(_width, lines)), WRAP))
            placed[-1].append((at, span, lines))
            if down > 1:
                new |= dict.fromkeys(range(at, at + span), down)
            at += span
        taken = {c: n - 1 for c, n in (taken | new).items() if n > 1}
    for cells in placed:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            to, line = 0, []
            for at, span, lines in cells:
                line += [" " * widths.get(x, 0) for x in range(to, at)]
                text = lines[i] if i < len(lines) else ""
                line.append(text + " " * (sum(widths.get(x, 0) for x in range(at, at + span)) + 2 * (span - 1) - _width(text)))
                to = at + span
            out.text("  ".join(line), True)
            out.line()


def _own_text(node: Node) -> str:
    """What an element without children shows: an image's alt text, an input's value."""
    a = node.attributes
    if node.tag == "img" or (node.tag == "input" and a.get("type", "").lower() == "image"):
        return a.get("alt", "")
    if node.tag == "input" and a.get("type", "").lower() not in ("hidden", "checkbox", "radio", "password", "file", "color", "range"):
        return a.get("value") or a.get("placeholder", "")
    return ""


def _render(out: _Lines, node: Node, rules: Rules, kept: bool) -> None:
    """Writes a node and what is in it."""
    if not seen(node, rules):
        return
    if node.tag == "br":
        out.line(True)
        return
    if node.tag in ("img", "input"):
        if node.shown:
            out.text(_own_text(node), False)
        return
    block, kept = node.tag in BLOCK, kept or node.tag in ("pre", "textarea", "xmp")
    if block:
        out.block(node.tag in SPACED)
    if node.tag == "table":
        _table(out, node, rules)
    else:
        children, number, before = node.children, 0, out.indent
        if node.tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if node.tag in ("blockquote", "dd"):
            out.indent += "  "
        if node.tag == "ol":
            start = node.attributes.get("start", "1")
            number = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
        for c in children:
            if isinstance(c, str):
                if node.shown:
                    out.text(c, kept)
            elif c.tag == "li" and seen(c, rules):
                out.block(False)
                number += 1
                mark = f"{number}. " if node.tag == "ol" else "- "
                indent, out.indent, out.marker = out.indent, _deeper(out.indent, len(mark)), mark
                _render(out, c, rules, kept)
                out.line()
                out.indent, out.marker = indent, ""
            else:
                _render(out, c, rules, kept)
        if block:
            out.line()
        out.indent = before
    if block:
        out.block(node.tag in SPACED)


def _deeper(indent: str, n: int) -> str:
    """An indent of n more columns; none grows far beyond what is written of it."""
    return indent + " " * n if len(indent) <= INDENT else indent


def render(node: Node, rules: Rules) -> str:
    """The visible text inside a node."""
    out = _Lines()
    for c in node.children:
        if not isinstance(c, str):
            _render(out, c, rules, False)
        elif node.shown is not False:
            out.text(c, False)
    out.line()
    return "\n".join(out.done).strip("\n")


def visible_text(page: str) -> str:
    root, styles, depth = parse(page)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * depth + 1000))  # calls between Python functions take no stack of the machine's
    return render(root, Rules(styles))


def _extracted(batch: pa.RecordBatch, carried: list[str]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batch, "html"):
        texts = [None if h is None else visible_text(h) for h in column(part, "html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(column(part, c) for c in carried), pa.array(texts, pa.string())], [*carried, "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html; other columns are ignored).

    A null page has a null text; an empty one, or one without visible text, an empty text. Broken markup is read as
    far as it goes. Rows come back one for one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    carried = ["page_id", "url"]
    return arrow_map(pages.select(*carried, "html"), lambda b: _extracted(b, carried), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")

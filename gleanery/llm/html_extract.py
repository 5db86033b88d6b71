"""HTML to text with the layout kept.

A tree builder takes tags as a browser would (implied ends, void elements, unclosed elements, raw text elements), a
visibility rule drops what is not shown, and a renderer writes the tree: inline text with collapsed white space, a blank
line between paragraphs, a marker before list items, and table cells in aligned columns. Formulas give their symbols in
order, drawings their text elements, selects the options that they show.

Open elements are found by name, tags are scanned without going back, and tables are laid out from the innermost out, so the
work grows with the page's length whatever its markup, and no depth of nesting has rules of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from string import ascii_letters

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas annotation annotation-xml mphantom".split())
#: Elements of a drawing that draw nothing where they stand.
NOT_DRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
#: Start tags that end an open drawing or formula.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup "
    "table tt u ul var".split()
)
#: Elements of drawings and formulas that hold HTML.
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table ul caption tr tbody thead tfoot td th".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol pre table ul menu dir".split())
#: A start tag that ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre section summary table ul li dd dt".split()
)
#: A start tag that ends open elements, as far up as the elements that bound the search.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
}
#: Elements that an open head takes; any other, and text that isn't blank, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: End tags don't reach through these, but for those of REACHES.
SCOPE = frozenset("table td th caption html".split())
REACHES = frozenset("table tr td th tbody thead tfoot caption html body".split())
#: An end tag of these leaves the blocks open that began in the element.
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BOUNDS_P = SCOPE | {"button"}

#: Where markup begins: any other "<" is text.
_MARKUP = re.compile(r"<(?=[a-zA-Z!?/])")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
# A name, and a value in quotes or bare; quotes that stay open take all the rest, as in a browser.
_NAMED = r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+)|(?=>)))?+"""
_ATTR = re.compile(_NAMED)
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]*+{re.sub(r'(?<!\\)\((?!\?)', '(?:', _NAMED)})*+)([ \t\n\r\f/]*+)>")
_INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]+)")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Spaces before a line, characters that a column is padded to, and characters of a row up to which cells are aligned.
INDENT, COLUMN, ALIGNED = 80, 80, 400
#: The most columns and rows that a cell may span, as in the HTML standard.
COLSPAN, ROWSPAN = 1000, 65534
LINKS = {"a": ("href",), "area": ("href",), "link": ("href",), "img": ("src",), "script": ("src",), "iframe": ("src",)}
LETTERS = frozenset(ascii_letters)
_NO_ATTRS: dict[str, str] = {}


class Node:
    """``foreign``: what it holds is read as part of a drawing or formula. ``lines``: a table's, once it is laid out."""

    __slots__ = ("name", "children", "attrs", "foreign", "lines")

    def __init__(self, name: str, attrs: dict[str, str] = _NO_ATTRS):
        self.name, self.children, self.attrs, self.foreign, self.lines = name, [], attrs, False, ()


class Page:
    """The tree of a page, and its tables, its links, its style sheets and its title in document order."""

    def __init__(self, html: str):
        self.root, self.tables, self.linked, self.sheets, self.named = Node("#root"), [], [], [], None
        build(html, self)
        if rules := visibility_rules("\n".join(self.sheets)):
            hide(self.root, rules)

    def text(self) -> str:
        for table in reversed(self.tables):  # tables in cells come after the table around them
            table.lines = table_lines(table)
        return render([self.root])

    def title(self) -> str | None:
        return None if self.named is None else _SPACE.sub(" ", "".join(x for x in self.named.children if isinstance(x, str))).strip()

    def links(self) -> list[tuple[str, str, str]]:
        """(element, attribute, url) of each link."""
        return [(n.name, a, n.attrs[a].strip()) for n in self.linked for a in LINKS[n.name] if a in n.attrs]


class Open:
    """The open elements, and the depths at which those of a name stand."""

    def __init__(self, root: Node):
        self.nodes, self.depths = [root], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Closes the elements from a depth on."""
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().name].pop()

    def innermost(self, names) -> int:
        """The depth of the innermost open element of these names, 0 for none."""
        return max([at[-1] for n in names if (at := self.depths.get(n))], default=0)

    def close(self, names: tuple[str, ...], bounds) -> None:
        """Closes the outermost of ``names`` above the innermost bound, and all in it; of paragraphs the innermost."""
        held = [at for n in names if (at := self.depths.get(n))]
        if not held:
            return
        floor = self.innermost(bounds)
        first = [at[-1] if names == ("p",) else at[k] for at in held if (k := bisect_right(at, floor)) < len(at)]
        if first:
            self.cut(min(first))

    def end(self, name: str) -> None:
        """An end tag."""
        depth = self.innermost((name,))
        if not depth:
            if name in ("br", "p"):  # an end tag alone makes an empty element
                self.nodes[-1].children.append(Node(name))
        elif depth == len(self.nodes) - 1 or name in REACHES or self.innermost(BLOCK if name in FORMATS else SCOPE) <= depth:
            self.cut(depth)


def attributes(source: str) -> dict[str, str]:
    """The first value of each name."""
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def integer(source: str, default: int, least: int, most: int) -> int:
    """The ASCII digits that a value begins with, between two bounds; ``default`` without any."""
    found = _INTEGER.match(source)
    if not found:
        return default
    digits = found[1]
    value = int(digits) if len(digits) < 12 else most + 1 if digits[0] != "-" else least - 1
    return max(least, min(most, value))


def build(html: str, page: Page) -> None:
    """Fills the tree of a page; any text has one."""
    stack = Open(page.root)
    nodes = stack.nodes
    at, size = 0, len(html)
    while at < size:
        found = _MARKUP.search(html, at)
        start = found.start() if found else size
        if start > at:
            text = unescape(html[at:start])
            if nodes[-1].name == "head" and text.strip(" \t\n\r\f"):
                stack.cut(len(nodes) - 1)
            nodes[-1].children.append(text)
        if not found:
            break
        if html[start + 1] not in LETTERS and not (html[start + 1] == "/" and html[start + 2 : start + 3] in LETTERS):
            at = _passed_over(html, start, nodes[-1])
            continue
        tag = _TAG.match(html, start)
        if not tag:  # a tag that stays open: a browser drops all the rest
            break
        at = tag.end()
        name = tag[2].lower()
        if nodes[-1].name == "head" and (name == "br" if tag[1] else name not in IN_HEAD):
            stack.cut(len(nodes) - 1)
        if tag[1]:
            stack.end(name)
            continue
        within = nodes[-1].foreign
        if within and name in BREAKS_OUT:
            while nodes[-1].foreign:
                stack.cut(len(nodes) - 1)
            within = False
        if name in ENDS_P:
            stack.close(("p",), BOUNDS_P)
        if name in IMPLIED:
            stack.close(*IMPLIED[name])
        if name in ("body", "frameset"):
            stack.close(("head",), ())
        node = Node(name, attributes(tag[3]) if tag[3] else _NO_ATTRS)
        nodes[-1].children.append(node)
        if name == "table":
            page.tables.append(node)
        elif name in LINKS:
            page.linked.append(node)
        if within or name in ("svg", "math"):
            if tag[4].endswith("/"):
                continue
            node.foreign = name not in HOLDS_HTML and not (name == "annotation-xml" and "html" in node.attrs.get("encoding", "").lower())
        elif name == "title" and page.named is None:
            page.named = node
        if name in VOID:
            continue
        if name in RAW:
            end = _raw_end(html, name, at)
            if name in ("textarea", "title"):
                node.children.append(unescape(html[at : end[0]]))
            elif name == "xmp":
                node.children.append(html[at : end[0]])
            elif name == "style" and _PROPERTY.search(html, at, end[0]):
                page.sheets.append(html[at : end[0]])
            at = end[1]
        else:
            stack.push(node)


def _passed_over(html: str, start: int, node: Node) -> int:
    """The end of a comment, declaration or instruction; a character section in a drawing or formula is text."""
    if html.startswith("<!--", start):
        return _COMMENT.match(html, start).end()
    if node.foreign and html.startswith("<![CDATA[", start):
        end = html.find("]]>", start)
        node.children.append(html[start + 9 : end if end >= 0 else len(html)])
        return end + 3 if end >= 0 else len(html)
    if html[start + 1 :] == "/":
        node.children.append("</")
    end = html.find(">", start)
    return end + 1 if end >= 0 else len(html)


_RAW_ENDS = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in RAW}


def _raw_end(html: str, name: str, at: int) -> tuple[int, int]:
    found = _RAW_ENDS[name].search(html, at)
    return (found.start(), found.end()) if found else (len(html), len(html))


def visible(node: Node) -> bool:
    if node.name in HIDDEN:
        return False
    a = node.attrs
    return not a or not ("hidden" in a or a.get("type", "").lower() == "hidden" and node.name == "input" or a.get("aria-hidden") == "true" and node.name == "i" or "style" in a and _NOT_SHOWN.search(a["style"]))


# A compound selector of a name, classes and ids; selectors of other kinds aren't weighed.
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_PIECES = re.compile(r"[^{};]*[{};]?")
_PROPERTY = re.compile(r"(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
_PART = re.compile(r"[.#][\w-]+")


#: By an id, class or name: the selectors that ask for it, as name and parts, with what they say of each property: its rank in the cascade, and whether it hides.
Rules = dict[str, list[tuple[str, frozenset[str], dict[str, tuple[tuple, bool]]]]]


def visibility_rules(sheet: str) -> Rules:
    """The rules of a style sheet that show or hide, by an id, a class or a name that their elements have; empty where none hides.

    Conditional blocks and states that a pointer or a script brings about don't count. What a selector with combinators or attributes shows
    isn't known here to be hidden, so the parts that it names hide nothing.
    """
    if "{" not in sheet:
        return {}
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
    found: list[tuple[str, str]] = []
    depth, skipped, prelude, body = 0, None, "", []
    for piece in _PIECES.findall(sheet):
        end = piece[-1:]
        if end == "{":
            if skipped is None and piece.lstrip().startswith("@"):
                skipped = depth
            depth, prelude, body = depth + 1, piece[:-1], []
        else:
            body.append(piece.rstrip(";}"))
            if end == "}":
                depth = max(0, depth - 1)
                if skipped is None and depth == 0:
                    found.append((prelude, ";".join(body)))
                elif skipped is not None and depth <= skipped:
                    skipped = None
                body = []
    if skipped is None and depth == 1:  # the sheet's end closes a block
        found.append((prelude, ";".join(body)))
    said: dict[tuple[str, frozenset[str]], dict[str, tuple[tuple, bool]]] = {}
    doubtful: set[str] = set()
    for order, (selectors, block) in enumerate(found):
        declared = {p.lower(): (v.lower() in ("none", "hidden", "collapse"), bool(i)) for p, v, i in _PROPERTY.findall(block)}
        if not declared:
            continue
        for selector in selectors.split(","):
            selector = selector.strip()
            match = _COMPOUND.fullmatch(selector)
            parts = frozenset(_PART.findall(selector))
            if not selector or not match:
                if ":" not in selector and not all(hidden for hidden, _ in declared.values()):
                    doubtful |= parts
                continue
            ids = sum(p[0] == "#" for p in parts)
            tag = (match[1] or "*").lower()
            says = said.setdefault((tag, parts), {})
            for name, (hidden, important) in declared.items():
                rank = (important, ids, len(parts) - ids, tag != "*", order)
                says[name] = max(says.get(name, (rank, hidden)), (rank, hidden))
    if not any(hidden for says in said.values() for _, hidden in says.values()):
        return {}
    asked = Counter(p for _, parts in said for p in parts)
    rules: Rules = {}
    for (tag, parts), says in said.items():
        if not parts & doubtful:  # kept by the part that fewest selectors ask for
            rules.setdefault(min(parts, key=lambda p: (asked[p], p), default=tag), []).append((tag, parts, says))
    return rules


def hide(root: Node, rules: Rules) -> None:
    """Marks the elements that the rules hide; an element's own style goes before all but important ones."""
    work = [root]
    while work:
        node = work.pop()
        work += [c for c in node.children if not isinstance(c, str)]
        own = {f".{c}" for c in node.attrs["class"].split()} if "class" in node.attrs else set()
        if "id" in node.attrs:
            own.add(f"#{node.attrs['id'].strip()}")
        best: dict[str, tuple[tuple, bool]] = {}
        for key in (*own, node.name, "*"):
            for tag, parts, says in rules.get(key, ()):
                if parts <= own and tag in ("*", node.name):
                    for name, said in says.items():
                        best[name] = max(best.get(name, said), said)
        if best and "style" in node.attrs:
            own_style = {p.lower() for p, _, _ in _PROPERTY.findall(node.attrs["style"])}
            best = {p: said for p, said in best.items() if said[0][0] or p not in own_style}
        if any(hidden for _, hidden in best.values()):
            node.attrs = {**node.attrs, "hidden": ""}


def svg_labels(svg: Node) -> list[Node | str]:
    """The text elements of a drawing, parted by spaces, and the HTML that it holds."""
    out: list[Node | str] = []
    work: list = [(c, False) for c in reversed(svg.children)]
    while work:
        item, in_text = work.pop()
        if isinstance(item, str):
            if in_text:
                out.append(item)
        elif item.name in NOT_DRAWN or not visible(item) or item.attrs.get("display") == "none" or item.attrs.get("visibility") == "hidden":
            continue
        elif item.name == "foreignobject":
            out += [" ", item, " "]
        else:
            if item.name == "text":
                out.append(" ")
                work.append((" ", True))
            work.extend((c, in_text or item.name == "text") for c in reversed(item.children))
    return out


def shown_options(select: Node) -> list[str]:
    """What a select shows: all options of a list box, else the last that is selected, or the first that isn't disabled."""
    box = "multiple" in select.attrs or integer(select.attrs.get("size", ""), 1, 0, 2) > 1
    options: list[tuple[str, bool, bool]] = []
    work: list = [(c, False) for c in reversed(select.children)]
    while work:
        item, off = work.pop()
        if isinstance(item, str) or not visible(item):
            continue
        off = off or "disabled" in item.attrs
        if item.name == "option":
            options.append((item.attrs.get("label") or _SPACE.sub(" ", _plain(item)).strip(" "), "selected" in item.attrs, off))
        else:
            if item.name == "optgroup" and box and item.attrs.get("label"):
                options.append((item.attrs["label"], False, True))
            work.extend((c, off) for c in reversed(item.children))
    if box:
        return [x for x, _, _ in options if x]
    shown = [x for x, selected, _ in options if selected][-1:] or [x for x, _, off in options if not off][:1]
    return [x for x in shown if x]


def _plain(node: Node) -> str:
    out, work = [], [node]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.name not in ("script", "style"):
            work.extend(reversed(item.children))
    return "".join(out)


class Lines:
    """Text under way: closed lines, the open line, and the blank lines that are due before the next."""

    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []
        self.gap = 0
        self.prefix = ""
        self.mark: str | None = None
        self.pending_space = False

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if words == " " or not words:
            self.pending_space = self.pending_space or bool(words)
            return
        lead = words[0] == " " or self.pending_space
        self.pending_space = words[-1] == " "
        self._put((" " if lead and self.open else "") + words.strip(" "))

    def exact(self, s: str) -> None:
        for i, line in enumerate(s.split("\n")):
            if i:
                self.line_break()
            if line:
                self._put(line)

    def _put(self, s: str) -> None:
        if not self.open:
            self.done += [""] * (self.gap if self.done else 0)
            self.gap = 0
            if self.prefix or self.mark:
                self.open.append(self.prefix + (self.mark or ""))
            if self.mark is not None:
                self.indent(len(self.mark))
                self.mark = None
        self.open.append(s)

    def indent(self, n: int) -> None:
        self.prefix = " " * min(INDENT, len(self.prefix) + n)

    def line_break(self) -> None:
        if self.open:
            self.done.append("".join(self.open).rstrip())
            self.open = []
        elif self.done or self.mark is not None:
            self.done.append("")
        self.pending_space = False

    def block(self, blank: int) -> None:
        if self.open:
            self.done.append("".join(self.open).rstrip())
            self.open = []
        self.gap = max(self.gap, blank)
        self.pending_space = False

    def finish(self) -> str:
        self.block(0)
        return "\n".join(self.done).strip("\n")


def render(nodes: list[Node | str]) -> str:
    """The visible text of some trees, whose tables are laid out. Works through an explicit stack, so any depth of nesting is rendered."""
    out = Lines()
    # Steps: a node or text to render, or a function to call at the end of a block.
    work: list = [(n, False) for n in reversed(nodes)]
    lists: list[list] = []
    while work:
        step = work.pop()
        if callable(step):
            step()
            continue
        item, pre = step
        if isinstance(item, str):
            out.exact(item) if pre else out.text(item)
            continue
        name = item.name
        if not visible(item):
            continue
        if name == "br":
            out.line_break()
        elif name == "hr":
            out.block(0)
        elif name == "img":
            if item.attrs.get("alt"):
                out.text(item.attrs["alt"])
        elif name == "input":
            if item.attrs.get("value") and item.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                out.text(item.attrs["value"])
        elif name == "svg":
            work.extend((c, pre) for c in reversed(svg_labels(item)))
        elif name == "select":
            for i, line in enumerate(shown_options(item)):
                if i:
                    out.line_break()
                out.text(line)
        elif name == "table":
            out.block(1)
            for line in item.lines:
                out.exact(line)
                out.block(0)
            out.block(1)
        else:
            block = name in BLOCK
            if block:
                blank = int(name in SPACED and not (lists and name in ("ul", "ol", "menu", "dir")))
                out.block(blank)
                before = out.prefix
                if name in ("ul", "ol", "menu", "dir"):
                    lists.append([name, integer(item.attrs.get("start", ""), 1, -(2**31), 2**31)])
                elif name == "li":
                    if lists and lists[-1][0] == "ol":
                        lists[-1][1] = integer(item.attrs.get("value", ""), lists[-1][1], -(2**31), 2**31)
                        out.mark, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
                    else:
                        out.mark = "- "
                elif name in ("blockquote", "dd"):
                    out.indent(2)
                work.append(_closer(out, before, blank, lists if name in ("ul", "ol", "menu", "dir") else None))
            if name == "mtd":  # cells of a matrix stand apart
                out.text(" ")
            inner = pre or name in ("pre", "textarea", "xmp")
            work.extend((c, inner) for c in reversed(item.children))
    return out.finish()


def _closer(out: Lines, prefix: str, blank: int, lists: list | None):
    def close() -> None:
        out.block(blank)
        out.prefix, out.mark = prefix, None
        if lists:
            lists.pop()

    return close


def table_lines(table: Node) -> list[str]:
    """Captions, then rows: a cell stands in the first free columns of its row, cells of several lines are joined by a space, columns are as wide as their widest cell.

    A column is padded to at most COLUMN characters and a row up to ALIGNED; what is wider pushes the rest of its row on.
    """
    captions, grid = [], Grid()
    work = list(reversed(table.children))
    while work:
        item = work.pop()
        if item is None:
            grid.spans = []
        elif isinstance(item, str):
            if item.strip():
                captions.append(_SPACE.sub(" ", item).strip())
        elif not visible(item):
            continue
        elif item.name == "tr":
            grid.row(item)
        elif item.name in ("tbody", "thead", "tfoot"):
            grid.spans = []  # a cell reaches to the end of its row group
            work.append(None)
            work.extend(reversed(item.children))
        else:
            captions.append(render([item]))
    return [x for x in captions if x] + grid.lines()


class Grid:
    """The cells of a table by row and column; ``spans`` are the columns that earlier rows' cells hold: first, end, rows left."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, str]]] = []
        self.spans: list[tuple[int, int, int]] = []

    def row(self, row: Node) -> None:
        at, k, cells, spans = 0, 0, [], []
        for cell in row.children:
            if isinstance(cell, str):
                text, wide, high = _SPACE.sub(" ", cell).strip(), 1, 1
                if not text:
                    continue
            elif not visible(cell):
                continue
            else:
                text = " ".join([x.strip() for x in render(cell.children).split("\n") if x.strip()])
                wide = integer(cell.attrs["colspan"], 1, 1, COLSPAN) if "colspan" in cell.attrs else 1
                high = integer(cell.attrs["rowspan"], 1, 0, ROWSPAN) if "rowspan" in cell.attrs else 1
            while k < len(self.spans) and self.spans[k][0] <= at:
                at = max(at, self.spans[k][1])
                k += 1
            cells.append((at, wide, text))
            if high != 1:  # 0: to the end of the row group
                spans.append((at, at + wide, (high or ROWSPAN) - 1))
            at += wide
        self.rows.append(cells)
        held: list[tuple[int, int, int]] = []
        for first, end, left in sorted([(a, b, n - 1) for a, b, n in self.spans if n > 1] + spans):
            if held and held[-1][1] == first and held[-1][2] == left:
                held[-1] = (held[-1][0], end, left)
            else:
                held.append((first, end, left))
        self.spans = held

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        spanning: dict[tuple[int, int], int] = {}
        for cells in self.rows:
            for at, wide, text in cells:
                if text:
                    widths[at] = max(widths.get(at, 0), min(len(text), COLUMN) if wide == 1 else 1)
                    if wide > 1:
                        spanning[at, at + wide] = max(spanning.get((at, at + wide), 0), min(len(text), COLUMN))
        for (first, end), most in sorted(spanning.items()):  # the last column of a cell that spans takes what the others lack
            held = [c for c in range(first, end) if c in widths]
            widths[held[-1]] += max(0, most + 2 - sum(widths[c] + 2 for c in held))
        starts, place = {}, 0
        for at in sorted(widths):
            starts[at] = min(place, ALIGNED)
            place += widths[at] + 2
        out = []
        for cells in self.rows:
            parts, length = [], 0
            for at, _, text in cells:
                if text:
                    pad = max(starts[at] - length, 2 if parts else 0)
                    if pad:
                        parts.append(" " * pad)
                    parts.append(text)
                    length += pad + len(text)
            if parts:
                out.append("".join(parts))
        return out


def html_to_text(html: str | None) -> str | None:
    return None if html is None else Page(html).text()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """(page_id, title, text) and the columns in ``keep``, prefixed ``kept_``, a row for each row of pages.

    A null page has null text and title; a page without visible text the empty text; text outside any tag is text; broken
    markup is read as a browser would, numbers that are none count as missing. Tables inside cells are rendered in the cell's
    line. What inline styles, attributes or the simple selectors of the page's own style sheets hide is left out. Pages of any length are read whole; repeated rows give repeated rows. An empty table gives no rows. The title is the
    first title element's.
    """
    keep = keep or []
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").alias("html"), *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = [], []
            for html in batch.column("html").to_pylist():
                page = None if html is None else Page(html)
                titles.append(page and page.title())
                texts.append(page and page.text())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(titles, pa.string()), pa.array(texts, pa.string()), *[batch.column(f"kept_{c}") for c in keep]], names=["page_id", "title", "text", *[f"kept_{c}" for c in keep]])

    return rows.mapInArrow(run, ", ".join([f"page_id {kinds['page_id']}", "title string, text string", *[f"`kept_{c}` {kinds[f'kept_{c}']}" for c in keep]]))

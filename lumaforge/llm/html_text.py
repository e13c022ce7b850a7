"""Layout-aware HTML extraction: a tree with implied tags, visibility rules, and rendering to text.

All visible text is kept, in order: navigation, advertisements and footers as well as articles. Blocks start on
lines of their own, paragraphs, headings, lists and tables stand apart by a blank line, list items have their
bullet or number and are indented by depth, table cells are padded to the width of their column, and ``pre`` keeps
its white space. Text in a table but outside its cells stands before the table, as browsers show it. Formulas are read in order; of inline drawings
the text elements are kept. Invisible are the head, scripts, styles, templates, embedded media, elements that are hidden by an
attribute or an inline style, closed dialogs, and closed details but for their summary.

A null or empty page gives an empty text; text without any tag is one block. Markup that is broken off or badly
nested never fails: end tags without a start are ignored, and open elements end with the page. Depth is not
limited, since nothing recurses. Pages are handled one by one, repeated or not. Only the named columns are read.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
HEAD_ONLY = set("base basefont bgsound link meta noscript script style template title head html".split())
UNSEEN = set("head script style title template noscript iframe noembed noframes object audio video canvas datalist area mphantom".split())
#: Not seen within a drawing; elements whose text it shows; tags that end an unclosed drawing or formula; what may hold them all the same.
DRAWING_UNSEEN = {"desc", "defs", "metadata"}
DRAWING_TEXT = {"text", "foreignobject"}
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Formula elements whose children stand apart.
SPACED = set("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtr".split())
APART = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu xmp".split())
BLOCKS = APART | set(
    "html body address article aside center details dialog dir div dd dt fieldset figcaption footer form header "
    "hgroup legend li main nav option optgroup search section summary tr caption thead tbody tfoot".split()
)
ENDS_P = BLOCKS - set("html body option optgroup tr thead tbody tfoot caption legend".split())
LISTS = {"ul", "ol", "menu", "dir"}
CELLS = {"td", "th"}
GROUPS = {"thead", "tbody", "tfoot"}
#: A start tag ends the nearest open one of the first set, unless one of the second is in between.
ENDS = {
    "li": ({"li"}, LISTS | CELLS | {"table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"} | CELLS),
    "dd": ({"dt", "dd"}, {"dl", "table"} | CELLS),
    "td": (CELLS, {"tr", "table"}),
    "th": (CELLS, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": (GROUPS | {"tr", "caption"}, {"table"}),
    "tbody": (GROUPS | {"tr", "caption"}, {"table"}),
    "tfoot": (GROUPS | {"tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    **{f"h{i}": ({f"h{j}" for j in range(1, 7)}, BLOCKS - {f"h{j}" for j in range(1, 7)}) for i in range(1, 7)},
}

#: Columns wider than this are not padded.
WIDEST = 80
INDENT = 2

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*>?",
    re.DOTALL,
)
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/\Z")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, rest: str = ""):
        self.tag = tag
        self.attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /\n\t") else {}
        self.children: list = []

    def visible(self, parent: Node | None) -> bool:
        a = self.attributes
        if self.tag in UNSEEN or "hidden" in a or self.tag == "dialog" and "open" not in a:
            return False
        if parent is not None and parent.tag == "details" and "open" not in parent.attributes and self.tag != "summary":
            return False
        if parent is not None and parent.tag in ("semantics", "maction") and self is not next(c for c in parent.children if isinstance(c, Node)):
            return False
        return not _INVISIBLE.search(a.get("style", ""))


class Closings:
    """Where a tag ends whose name ends at a given place, for a page on which some do not.

    From each quote and bracket of the page the way leads to another one further on, so all are known after one pass.
    """

    def __init__(self, page: str):
        self.places = [m.start() for m in _SPECIAL.finditer(page)]
        self.ends: list[int | None] = [None] * (len(self.places) + 1)
        following = {'"': None, "'": None}
        for k in range(len(self.places) - 1, -1, -1):
            c = page[self.places[k]]
            if c == ">":
                self.ends[k] = self.places[k]
                continue
            # A quote with a partner hides what is between; one without is a character like others.
            partner = following[c]
            self.ends[k] = self.ends[k + 1 if partner is None else partner + 1]
            following[c] = k

    def after(self, place: int) -> int | None:
        return self.ends[bisect.bisect_left(self.places, place)]


def build(page: str) -> Node:
    """The page's tree; text is a child string."""
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each element name is open

    def innermost(tags: set) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def cut(size: int) -> None:
        for node in stack[size:]:
            places[node.tag].pop()
        del stack[size:]

    def opened(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    def close(tags: set, bounds: set) -> None:
        at = innermost(tags)
        if at > innermost(bounds - tags):
            cut(at)

    def add(node: Node) -> None:
        stack[-1].children.append(node)

    def text(value: str) -> None:
        if value:
            if stack[-1].tag == "head" and value.strip():
                cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(value))

    at = done = 0  # where the next tag is sought, and where text that is not yet in the tree starts
    closings: Closings | None = None
    while True:
        at = page.find("<", at)
        if at < 0:
            text(page[done:])
            return root
        name = _NAME.match(page, at)
        if name and closings and closings.after(name.end()) is None:
            at += 1
            continue
        m = _TAG.match(page, at)
        if m is None:
            if name and not closings:
                closings = Closings(page)
            at += 1
            continue
        text(page[done:at])
        at = done = m.end()
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "br":
                add(Node("br"))
            elif tag == "p" and not places["p"]:
                add(Node("p"))
            else:
                inner = CELLS | {"table", "caption"} if tag not in CELLS | GROUPS | {"table", "tr", "caption", "body", "html"} else set()
                close({tag}, {"table"} if tag in CELLS | GROUPS | {"tr"} else inner)
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            cut(len(stack) - 1)
        foreign = bool(places["svg"] or places["math"]) and innermost({"svg", "math"}) > innermost(HOLDS_HTML)
        while foreign and tag in BREAKS_OUT:
            close({"svg", "math"}, HOLDS_HTML)
            foreign = innermost({"svg", "math"}) > innermost(HOLDS_HTML)
        if tag in ENDS_P:
            close({"p"}, CELLS | {"table", "button", "caption", "object"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in CELLS and stack[-1].tag in GROUPS | {"table"}:
            add(Node("tr"))
            opened(stack[-1].children[-1])
        if tag in ("html", "body") and places[tag]:
            continue
        node = Node(tag, m["rest"])
        add(node)
        if tag in VOID:
            continue
        if (foreign or tag in ("svg", "math")) and m["rest"].endswith("/") and not _UNQUOTED.search(m["rest"]):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.IGNORECASE).search(page, at)
            node.children.append(html.unescape(page[at : end.start() if end else len(page)]) if tag == "textarea" else page[at : end.start() if end else len(page)])
            at = done = end.end() if end else len(page)
            continue
        opened(node)


class Flow:
    """Lines of text under an indent, with blank lines where blocks ask for them."""

    def __init__(self):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = 0
        self.marker = ""

    def write(self, value: str) -> None:
        words = _SPACE.split(value)
        for i, word in enumerate(words):
            if i:
                self.space = bool(self.current)
            if word:
                if self.space:
                    self.current.append(" ")
                    self.space = False
                self.current.append(word)

    def literal(self, value: str) -> None:
        for i, line in enumerate(value.split("\n")):
            if i:
                self.end_line(1, keep=True)
            if line:
                self.current.append(line)

    def end_line(self, gap: int, keep: bool = False) -> None:
        if self.current or keep:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            lead = " " * (self.indent - len(self.marker)) + self.marker
            self.lines.append((lead + "".join(self.current)).rstrip() if self.current else "")
            self.current, self.marker, self.gap = [], "", 0
        self.space = False
        self.gap = max(self.gap, gap, 1)

    def blocks(self, lines: list[str]) -> None:
        self.end_line(1)
        for line in lines:
            self.current = [line]
            self.end_line(1)

    def text(self) -> list[str]:
        self.end_line(1)
        return self.lines


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(m[1]) if m else default


class Table:
    """Rows of cells in a grid; a cell that spans leaves its other places empty."""

    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.taken: dict[int, int] = {}
        self.column = 0
        self.caption: list[str] = []

    def row(self) -> None:
        self.rows.append({})
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.column = 0

    def cell(self, node: Node, lines: list[str]) -> None:
        if not self.rows:
            self.row()
        while self.column in self.taken:
            self.column += 1
        wide = max(1, min(1000, _number(node.attributes.get("colspan"), 1)))
        high = max(1, min(65534, _number(node.attributes.get("rowspan"), 1)))
        self.rows[-1][self.column] = lines
        for c in range(self.column, self.column + wide):
            if high > 1:
                self.taken[c] = high
        self.column += wide

    def lines(self) -> list[str]:
        rows = [r for r in self.rows if any(r.values())]
        used = sorted({c for r in rows for c, lines in r.items() if lines})
        width = {c: min(WIDEST, max(len(x) for r in rows for x in r.get(c, []) or [""])) for c in used}
        out = list(self.caption)
        for r in rows:
            for i in range(max(len(r.get(c, [])) for c in used)):
                cells = [(r.get(c, [])[i] if i < len(r.get(c, [])) else "").ljust(width[c]) for c in used]
                out.append("  ".join(cells).rstrip())
        return out


def render(root: Node) -> str:
    """Text of the tree. The stack holds what is to be entered and, as callables, what is to be done on the way out."""
    flows = [Flow()]
    tables: list[Table] = []
    lists: list[list] = []
    kept = 0  # open elements that keep white space
    drawing = ""  # the innermost of svg, text and foreignobject, within a drawing

    def leave_block(gap):
        return lambda: flows[-1].end_line(gap)

    stack: list = [(root, None)]
    while stack:
        item = stack.pop()
        if callable(item):
            item()
            continue
        node, parent = item
        flow = flows[-1]
        if isinstance(node, str):
            if parent is not None and parent.tag == "details" and "open" not in parent.attributes or drawing == "svg":
                continue
            if kept:
                flow.literal(node.replace("\r\n", "\n"))
            elif parent is None or parent.tag not in GROUPS | {"table", "tr"} | LISTS or node.strip():
                flow.write(node)
            continue
        if not node.visible(parent) or drawing in ("svg", "text") and node.tag in DRAWING_UNSEEN:
            continue
        tag, after = node.tag, []
        if tag == "svg" or drawing == "svg" and tag in DRAWING_TEXT:

            def drawn(was=drawing):
                nonlocal drawing
                drawing = was
                flows[-1].write(" ")

            after.append(drawn)
            drawing = tag
        if drawing and (tag in DRAWING_TEXT or tag == "tspan" and node.attributes.keys() & {"x", "y", "dy"}) or parent is not None and parent.tag in SPACED:
            flow.write(" ")
        if tag == "br":
            flow.end_line(1, keep=True)
            continue
        if tag in BLOCKS:
            apart = 2 if tag in APART and not (tag in LISTS and lists) else 1
            flow.end_line(apart)
            after.append(leave_block(apart))
        if tag in LISTS:
            lists.append([tag == "ol", _number(node.attributes.get("start"), 1)])
            flow.indent += INDENT
            after.append(lambda f=flow: (lists.pop(), setattr(f, "indent", f.indent - INDENT)))
        elif tag == "li":
            ordered = lists[-1] if lists else [False, 1]
            number = _number(node.attributes.get("value"), ordered[1])
            flow.marker = f"{number}. " if ordered[0] else "- "
            ordered[1] = number + 1
            more = max(len(flow.marker) - (INDENT if lists else 0), 0)
            flow.indent += more
            after.append(lambda f=flow, n=more: (setattr(f, "indent", f.indent - n), setattr(f, "marker", "")))
        elif tag in ("dd", "blockquote"):
            flow.indent += 2 * INDENT
            after.append(lambda f=flow: setattr(f, "indent", f.indent - 2 * INDENT))
        elif tag in ("pre", "textarea", "xmp"):
            kept += 1
            if node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")

            def ended():
                nonlocal kept
                kept -= 1

            after.append(ended)
        elif tag == "table":
            tables.append(Table())
            after.append(lambda: flows[-1].blocks(tables.pop().lines()))
        elif tag == "tr" and tables:
            tables[-1].row()
        elif tag in CELLS | {"caption"} and tables:
            flows.append(Flow())
            outer, lists, was_kept, kept = lists, [], kept, 0

            def cell_done(n=node, outer=outer, was_kept=was_kept):
                nonlocal lists, kept
                lines = flows.pop().text()
                lists, kept = outer, was_kept
                if n.tag == "caption":
                    tables[-1].caption += lines
                else:
                    tables[-1].cell(n, lines)

            after = [cell_done]
        # A block ends its line before it gives up its indent.
        stack += after if tag in CELLS else after[1:] + after[:1] if tag in BLOCKS and tag != "table" else after
        stack += [(child, node) for child in reversed(node.children)]
    return "\n".join(flows[0].text()).replace("\xa0", " ")


def extract(page: str | None) -> str:
    return render(build(page)) if page else ""


def extract_pages(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """``key`` and ``text`` of every page."""

    def run(batches):
        for batch in batches:
            texts = [extract(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(markup).alias("html"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

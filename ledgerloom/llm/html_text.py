"""HTML extraction by layout-aware rendering: a tree builder with implied tags, and a renderer with visibility rules.

The builder opens and closes elements as browsers do where authors leave tags out (``p``, ``li``, ``dt dd``,
``option``, table parts, stray end tags, nested formatting). The renderer walks the tree with an explicit stack,
so depth costs no recursion. It leaves out what is not shown (``head``, ``script``, ``style``, ``template``,
``hidden``, ``display:none``, comments and the like; ``visibility:hidden`` is inherited until a descendant resets
it), shows formulas, the text of ``svg``, all options of a ``select`` and the values of inputs that show them, collapses white space outside
``pre``, puts each block on its own lines with a blank line around paragraph-like blocks, marks list items by
bullets or running numbers with indent, and sets table cells in columns of equal width.

Null: null. Empty or unfinished markup, and bytes that are no markup, give what is visible of them. Very long
pages take memory in proportion. Equal rows give equal texts; all columns pass through ``extract``
(``rendered title`` are replaced); empty tables give empty results.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
UNSEEN = frozenset("head script style template title noembed noframes iframe object canvas audio video datalist annotation annotation-xml".split())
#: In ``svg`` only text elements and foreign objects show text, and not within definitions.
SVG_TEXT, SVG_UNSEEN = frozenset("text foreignobject".split()), frozenset("defs symbol metadata desc clippath mask marker pattern".split())
#: Inputs whose value isn't on the page.
VALUELESS = frozenset("hidden checkbox radio file image range color password".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
_CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr caption option optgroup legend".split())
_TABLE_SCOPE = frozenset("table template html".split())
#: A start tag closes the nearest open element of the first set, unless one of the second is nearer.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset(["tr"]), _TABLE_SCOPE),
    "td": (frozenset("td th".split()), _TABLE_SCOPE | {"tr"}),
    "th": (frozenset("td th".split()), _TABLE_SCOPE | {"tr"}),
    "tbody": (frozenset("tbody thead tfoot caption colgroup".split()), _TABLE_SCOPE),
    "thead": (frozenset("tbody thead tfoot caption colgroup".split()), _TABLE_SCOPE),
    "tfoot": (frozenset("tbody thead tfoot caption colgroup".split()), _TABLE_SCOPE),
    "body": (frozenset(["head"]), frozenset()),
}
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>\0]*)|[!?/])")
_ATTR = re.compile(r"[\s/]*+(?:>|([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?)")
_HIDING = re.compile(r"(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
#: States that a child inherits.
PRE, UNSHOWN, SVG, LABEL = 1, 2, 4, 8
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "resets")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []
        self.resets = False  # whether a descendant says that it is visible


def build(source: str) -> Node:
    """The tree of a page; texts are strings among the children."""
    root = Node("html")
    stack = [root]
    opened: dict[str, int] = {}  # open elements by tag: a search for one that isn't there costs nothing
    at, n = 0, len(source)

    def text(piece: str) -> None:
        if piece:
            if stack[-1].tag == "head" and not piece.isspace():
                close("head")
            stack[-1].kids.append(html.unescape(piece) if "&" in piece else piece)

    def close(tag: str, stop: frozenset = frozenset()) -> bool:
        if not opened.get(tag):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                drop(i)
                return True
            if stack[i].tag in stop:
                return False
        return False

    def drop(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def push(x: Node) -> None:
        stack[-1].kids.append(x)
        stack.append(x)
        opened[x.tag] = opened.get(x.tag, 0) + 1

    def foreign() -> bool:
        if not opened.get("svg") and not opened.get("math"):
            return False
        return next((x.tag for x in reversed(stack) if x.tag in ("svg", "math", "foreignobject")), "") in ("svg", "math")

    while at < n:
        m = _TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        name = m[2]
        if name is None:
            if source.startswith("<!--", m.start()):
                end = source.find("-->", m.end())
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", m.end())
                at = n if end < 0 else end + 1
            continue
        name, attrs, at, empty = name.lower(), {}, m.end(), False
        while True:
            a = _ATTR.match(source, at)
            if not a:
                at = n if at >= n or source.find(">", at) < 0 else at + 1
                if at >= n:
                    break
                continue
            at = a.end()
            if a[1] is None:
                empty = a[0].endswith("/>")
                break
            if not m[1]:
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
                attrs.setdefault(a[1].lower(), html.unescape(value) if "&" in value else value)
        if m[1]:
            if name == "br":
                stack[-1].kids.append(Node("br"))
            elif name == "p":
                if not close("p", frozenset(["table", "td", "th"])):
                    stack[-1].kids.append(Node("p"))
            elif name in ("html", "body"):
                pass  # what follows still belongs to the body
            elif name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
                close(name, frozenset(["table"]))
            else:
                close(name, frozenset(["td", "th"]) if name not in ("table",) else frozenset())
            continue
        if name == "html":
            root.attrs = attrs | root.attrs
            continue
        if stack[-1].tag == "head" and name not in HEAD_ONLY:
            close("head")
        if name in _CLOSES_P:
            close("p", frozenset("table td th button".split()))
        if name in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            drop(len(stack) - 1)
        if name in IMPLIED and any(opened.get(x) for x in IMPLIED[name][0]):
            shut, stop = IMPLIED[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    drop(i)
                    break
                if stack[i].tag in stop:
                    break
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr"))
        node = Node(name, attrs)
        if "style" in attrs and visibility(node) is True:
            for x in reversed(stack):
                if x.resets:
                    break
                x.resets = True
        if empty and (name in ("svg", "math") or foreign()):
            stack[-1].kids.append(node)
            continue
        if name not in RAW and name not in VOID:
            push(node)
            continue
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            stop = n if end is None else end.start()
            node.kids.append(html.unescape(source[at:stop]) if name in ("textarea", "title") else source[at:stop])
            tail = source.find(">", stop)
            at = n if end is None or tail < 0 else tail + 1
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").strip().lower() == "hidden"):
        return False
    return not ("style" in a and _HIDING.search(a["style"]))


def visibility(node: Node) -> bool | None:
    """What the element's style says; None: as its parent."""
    said = _VISIBILITY.findall(node.attrs.get("style", ""))
    return said[-1].lower() in ("visible", "initial") if said else None


def title(root: Node) -> str | None:
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag == "title":
            return _SPACE.sub(" ", "".join(k for k in x.kids if isinstance(k, str))).strip()
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return None


def width(text: str) -> int:
    """Columns of a fixed-width screen."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines of a block formatting context."""

    __slots__ = ("lines", "line", "gap", "indent", "first")

    def __init__(self):
        self.lines, self.line, self.gap, self.indent, self.first = [], [], 0, "", None

    def put(self, text: str, pre: bool) -> None:
        if pre:
            parts = text.replace("\r\n", "\n").split("\n")
            for i, p in enumerate(parts):
                if i:
                    self.end(keep=True)
                if p:
                    self.line.append(p)
            return
        text = _SPACE.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1][-1:] == " "):
            text = text[1:]
        if text:
            self.line.append(text)

    def end(self, keep: bool = False) -> None:
        text = "".join(self.line)
        self.line = []
        if not keep:
            text = text.rstrip(" ")
        if not text and not keep:
            return
        if self.gap and self.lines and text:
            self.lines.append("")
        self.gap = 0 if text else self.gap
        lead = self.indent
        if self.first is not None:
            lead, self.first = self.first, None
        self.lines.append((lead + text).rstrip() if not text else lead + text)

    def space(self) -> None:
        self.end()
        self.gap = 1


def render(root: Node) -> str:
    """All visible text."""
    flow = _Flow()
    # (what, payload): "node" to open, or a closing action
    stack: list[tuple] = [("node", root, 0)]
    flows: list[_Flow] = []
    lists: list[list] = []
    tables: list[list] = []
    while stack:
        what, x, pre = stack.pop()
        if what == "node":
            if isinstance(x, str):
                if not pre & UNSHOWN and (not pre & SVG or pre & LABEL):
                    flow.put(x, bool(pre & PRE))
                continue
            if not visible(x) or (pre & SVG and x.tag in SVG_UNSEEN):
                continue
            tag = x.tag
            if (said := visibility(x)) is not None:
                pre = pre & ~UNSHOWN if said else pre | UNSHOWN
            if pre & UNSHOWN and not x.resets:
                continue
            if tag == "svg":
                pre = pre & ~LABEL | SVG
            elif pre & SVG and tag in SVG_TEXT:
                flow.put(" ", False)
                pre = pre & ~SVG if tag == "foreignobject" else pre | LABEL
            if tag == "input":
                kind = x.attrs.get("type", "").strip().lower()
                value = x.attrs.get("alt" if kind == "image" else "value", "")
                if value.strip() and (kind == "image" or kind not in VALUELESS):
                    flow.put(f" {value} ", False)
                continue
            label = x.attrs.get("label", "").strip() if tag in ("option", "optgroup") else ""
            if tag == "br":
                flow.end(keep=True)
                continue
            if tag == "hr":
                flow.space()
                continue
            if tag == "img":
                if x.attrs.get("alt", "").strip():
                    flow.put(x.attrs["alt"], False)
                continue
            if tag == "wbr":
                continue
            inner = pre | PRE if tag in ("pre", "textarea", "plaintext", "xmp") else pre
            if tag == "table":
                flow.space()
                tables.append([])
                flows.append(flow)
                flow = _Flow()
                stack.append(("table", x, pre))
            elif tag == "tr" and tables:
                tables[-1].append([])
                stack.append(("stray", x, pre))
            elif tag in ("td", "th") and tables and tables[-1]:
                flows.append(flow)
                flow = _Flow()
                stack.append(("cell", x, pre))
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.end()
                if not lists:
                    flow.space()
                start = x.attrs.get("start", "")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1, flow.indent])
                stack.append(("list", x, pre))
            elif tag == "li":
                flow.end()
                own = lists[-1] if lists else [False, 1, flow.indent]
                value = x.attrs.get("value", "")
                if own[0] and re.fullmatch(r"-?[0-9]{1,9}", value):
                    own[1] = int(value)
                mark = "" if pre & UNSHOWN else f"{own[1]}. " if own[0] else "- "
                own[1] += 1
                stack.append(("item", (flow.indent, flow.first), pre))
                flow.first, flow.indent = flow.indent + mark, flow.indent + " " * len(mark)
            elif tag == "dd" or tag == "blockquote":
                flow.space() if tag in SPACED else flow.end()
                stack.append(("indent", (flow.indent, tag), pre))
                flow.indent += "  "
            elif tag in SPACED:
                flow.space()
                stack.append(("spaced", x, pre))
            elif tag in BLOCK:
                flow.end()
                stack.append(("block", x, pre))
                if label and not pre & UNSHOWN:
                    flow.put(label, False)
                    if tag == "option":  # shown instead of its text
                        continue
                    flow.end()
            elif tag == "q" and not pre & UNSHOWN:
                flow.put("“", True)
                stack.append(("quote", x, pre))
            elif tag == "select" or (tag == "svg" and x.kids):
                flow.put(" ", False)
            stack += [("node", k, inner) for k in reversed(x.kids)]
        elif what == "list":
            flow.end()
            lists.pop()
            if not lists:
                flow.gap = 1
        elif what == "item":
            flow.end()
            if flow.first is not None:  # an empty item
                flow.lines.append(flow.first.rstrip())
            flow.indent, flow.first = x[0], None
        elif what == "indent":
            flow.end()
            flow.indent = x[0]
            if x[1] in SPACED:
                flow.gap = 1
        elif what == "spaced":
            flow.space()
        elif what == "block":
            flow.end()
        elif what == "quote":
            flow.put("”", True)
        elif what == "cell":
            flow.end()
            tables[-1][-1].append((_trim(flow.lines), _span(x, "colspan", 1000), _span(x, "rowspan", 65534)))
            flow = flows.pop()
        elif what == "table":
            flow.end()
            loose = _trim(flow.lines)
            flow = flows.pop()
            for line in [*loose, *_grid(tables.pop())]:
                flow.line = [line]
                flow.end()
            flow.gap = 1
    flow.end()
    return "\n".join(_trim(flow.lines))


def _trim(lines: list[str]) -> list[str]:
    a, b = 0, len(lines)
    while a < b and not lines[a].strip():
        a += 1
    while b > a and not lines[b - 1].strip():
        b -= 1
    return lines[a:b]


def _span(x: Node, name: str, most: int) -> int:
    given = x.attrs.get(name, "")
    if name == "rowspan" and given.strip() == "0":  # down to the last row
        return most
    return min(int(given), most) if re.fullmatch(r"[1-9][0-9]{0,5}", given) else 1


def _placed(rows: list[list]) -> list[list[tuple[int, list[str], int]]]:
    """(column, lines, columns) of the cells of each row; cells from rows above keep their columns."""
    out, taken = [], {}
    for r in rows:
        c, cells, below = 0, [], {k: n - 1 for k, n in taken.items() if n > 1}
        for lines, across, down in r:
            while taken.get(c):
                c += 1
            cells.append((c, lines, across))
            if down > 1:
                below |= dict.fromkeys(range(c, c + across), down - 1)
            c += across
        taken = below
        if cells:
            out.append(cells)
    return out


def _grid(rows: list[list]) -> list[str]:
    """Cells of a table in columns: each is as wide as its widest line that does not span."""
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for r in placed:
        for c, lines, across in r:
            if across == 1:
                widths[c] = max(widths.get(c, 0), max(map(width, lines), default=0))
    last = max((c + across for r in placed for c, _, across in r), default=0)
    left = [0]
    for c in range(last):
        left.append(left[-1] + widths.get(c, 0) + 2)
    out = []
    for r in placed:
        for k in range(max((len(lines) for _, lines, _ in r), default=0)):
            line, at = [], 0
            for i, (c, lines, _) in enumerate(r):
                gap = max(left[c] - at, 2 if i else 0)
                text = lines[k] if k < len(lines) else ""
                line.append(" " * gap + text)
                at += gap + width(text)
            out.append("".join(line).rstrip())
    return out


def text_of(source: str | None) -> tuple[str | None, str | None]:
    if source is None:
        return None, None
    root = build(source)
    return render(root), title(root)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``rendered`` (all visible text) and ``title`` to every row."""
    pages = pages.drop("rendered", "title")
    names = pages.columns
    at = names.index(column)

    def run(batches):
        for b in batches:
            out = [text_of(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a for a, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], [*names, "rendered", "title"])

    return bounded(pages).mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("rendered", T.StringType()), T.StructField("title", T.StringType())]))


def op6_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract(pages).select("page_id", "title", "rendered", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))

"""Layout-aware text of HTML pages.

A tokenizer cuts a page into tags and text; a tree builder supplies the tags that HTML lets authors
leave out (ends of p, li, dt, dd, option, table parts; void elements have none); a renderer walks the
tree and emits all visible text: blocks on lines of their own, a blank line around
paragraphs and headings, list items with bullets or numbers under their nesting, preformatted text as it
stands, and table cells padded to columns. What is not shown is left out: head, scripts, styles,
templates, the `hidden` attribute, display:none, closed details and dialogs, and visibility:hidden but for
elements inside that are made visible again. The text of drawings (svg) is shown, their titles and descriptions are not.

Nesting has no bound: the tree is as deep as the page makes it, and places of open tags are indexed by name, so a deep page is
not searched for every tag. Columns are padded in full, unless that would make a table over PAD times its text plus PAD_FREE characters long;
then the widest columns give way until it does not.

Defined results: null gives null; an empty page or one without visible text gives the empty string;
markup that is cut off is read as far as it goes; entities that don't exist stay as they are; a quotation mark that is never closed ends
with its tag; a very long page is read whole, alone in its chunk. Each page is read by itself: repeated rows give equal texts, and there are no ties. A column called `text` keeps its name, and
the new one gets underscores; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import free_name, map_texts, ship

ship(__name__)

#: How much padding a table may have.
PAD, PAD_FREE = 8, 1 << 16
#: Lines that begin so are not indented further; no text is lost by it.
DEEPEST = " " * 200
#: HTML's own limits of colspan and rowspan.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>|</?[a-zA-Z][^>]*+>?|</[^>]*>?|[^<]++|<", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
HIDING = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas math param source track desc metadata defs".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu".split())
BLOCK = PARAGRAPH | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup hr legend li main nav optgroup option search section summary caption".split())
CLOSES_P = (BLOCK - {"html", "body", "option", "optgroup", "legend", "caption"}) | {"xmp", "plaintext", "listing"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: start tag -> (open tags that it ends, tags at which the search for them stops)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
P_SCOPE = ("table", "td", "th", "caption", "button", "template")
CELLS = ("td", "th", "caption")
TABLE_TAGS = frozenset("table tr tbody thead tfoot body html td th caption".split())
#: End tags that don't reach out of a table that is open inside their element.
INLINE_ENDS = frozenset("td th li p div span".split())
SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    """An element. seen: whether it takes part in the layout; shown: whether its own text is visible."""

    __slots__ = ("tag", "attrs", "kids", "seen", "shown")

    def __init__(self, tag: str, attrs: dict | None = None, seen: bool = True, shown: bool = True):
        self.tag, self.attrs, self.kids, self.seen, self.shown = tag, attrs or {}, [], seen, shown


class Open:
    """The stack of open elements, with the places of each name, so that a search needs no walk."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, i: int) -> None:
        """Close the element at place i and all inside it."""
        while len(self.nodes) > i:
            self.at[self.nodes.pop().tag].pop()

    def last(self, names) -> int:
        """The innermost place of an element with one of the names; 0 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


def attributes(tag: str, name: str) -> dict:
    rest = tag[len(name) + 1 :].rstrip(">").rstrip("/")
    if not rest.strip():
        return {}
    out: dict = {}
    for k, a, b, c in ATTRIBUTE.findall(rest):
        out.setdefault(k.lower(), html.unescape(a or b or c))
    return out


def build(page: str) -> Node:
    """The page's tree: nodes and strings."""
    root = Node("#root")
    open_ = Open(root)
    at = 0

    def end(tags: set, stops: set) -> None:
        i = open_.last(tags)
        if i and i >= open_.last(stops):
            while i > 1 and open_.nodes[i - 1].tag in tags and open_.nodes[i - 1].tag not in stops:
                i -= 1
            open_.cut(i)

    def close_p() -> None:
        i = open_.last(("p",))
        if i > open_.last(P_SCOPE):
            open_.cut(i)

    while m := TOKEN.match(page, at):
        token = m[0]
        at = m.end()
        top = open_.nodes[-1]
        if token[0] != "<" or token == "<":
            top.kids.append(token)
            continue
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                top.kids.append(token[9:].removesuffix("]]>"))
            continue
        t = TAG.match(token)
        if not t or token[-1] != ">":
            continue
        name = t[2].lower()
        if t[1]:
            if name == "br":
                top.kids.append(Node("br", shown=top.shown))
            i = open_.last((name,))
            walls = 0 if name in TABLE_TAGS else open_.last(CELLS)
            if name in INLINE_ENDS:
                walls = max(walls, open_.last(("table",)))
            if i and i >= walls:
                open_.cut(i)
            continue
        attrs = attributes(token, name)
        if name in CLOSES_P:
            close_p()
        if name in HEADINGS and open_.nodes[-1].tag in HEADINGS:
            open_.cut(len(open_.nodes) - 1)
        if name in ENDS:
            end(*ENDS[name])
        if name == "a" and (i := open_.last(("a",))) and i >= len(open_.nodes) - 3:
            open_.cut(i)
        top = open_.nodes[-1]
        style = attrs.get("style", "")
        said = VISIBILITY.findall(style)
        shown = said[-1].lower() == "visible" if said else top.shown
        node = Node(name, attrs, not ("hidden" in attrs or HIDING.search(style)), shown)
        top.kids.append(node)
        if name in VOID:
            continue
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            node.kids.append(page[at : stop.start()] if stop else page[at:])
            at = stop.start() if stop else len(page)
            gt = page.find(">", at)
            at = gt + 1 if stop and gt >= 0 else len(page)
            continue
        open_.push(node)
    return root


class Lines:
    """Text under way: finished lines, the line being written, and the blank lines due before the next text."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.due = 0
        self.space = False
        self.prefix = ""  # of the next line only: a bullet

    def text(self, s: str) -> None:
        s = html.unescape(s) if "&" in s else s
        parts = SPACE.split(s)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            self.put((" " if self.space and self.line else "") + body)
            self.space = len(parts) > 1 and not parts[-1]

    def put(self, s: str) -> None:
        if self.due:
            if self.done:
                self.done += [""] * (self.due - 1)
            self.due = 0
        if self.prefix:
            self.line.append(self.prefix)
            self.prefix = ""
        self.line.append(s)

    def flush(self) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def gap(self, n: int) -> None:
        """At least n line ends before the next text."""
        self.flush()
        self.due = max(self.due, n)

    def br(self) -> None:
        if self.line:
            self.flush()
        elif self.done and not self.due:
            self.done.append("")
        self.space = False


def visible(n: Node) -> bool:
    a = n.attrs
    return n.seen and n.tag not in UNSEEN and not (n.tag == "input" and a.get("type", "").lower() == "hidden") and not (n.tag == "dialog" and "open" not in a)


def render(n: Node, out: Lines, pre: bool = False) -> None:
    for k in n.kids:
        if isinstance(k, str):
            if not n.shown:
                continue
            if pre:
                rows = html.unescape(k).replace("\r\n", "\n").split("\n")
                for i, row in enumerate(rows):
                    if i:
                        out.flush() if out.line else out.done.append("")
                    if row:
                        out.put(row)
            else:
                out.text(k)
            continue
        if not visible(k):
            continue
        tag = k.tag
        if tag == "br":
            out.br()
        elif tag == "hr":
            out.gap(1)
        elif tag == "input":
            if k.shown and k.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                out.text(k.attrs.get("value", ""))
        elif tag == "table":
            out.gap(2)
            for row in table(k):
                out.put(row)
                out.flush()
            out.gap(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.gap(1 if n.tag in ("li", "ul", "ol") else 2)
            items(k, out)
            out.gap(1 if n.tag in ("li", "ul", "ol") else 2)
        elif tag == "details" and "open" not in k.attrs:
            out.gap(1)
            shut = Node("details", shown=k.shown)
            shut.kids = [x for x in k.kids if isinstance(x, Node) and x.tag == "summary"][:1]
            render(shut, out, pre)
            out.gap(1)
        elif tag in BLOCK:
            out.gap(2 if tag in PARAGRAPH else 1)
            if tag == "blockquote" or tag == "dd":
                indented(k, out, "  ", "  ")
            else:
                render(k, out, pre or tag == "pre")
            out.gap(2 if tag in PARAGRAPH else 1)
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):  # outside a table
            out.gap(1) if tag == "tr" else out.text(" ")
            render(k, out, pre)
            out.gap(1) if tag == "tr" else out.text(" ")
        else:
            render(k, out, pre or tag in ("textarea", "listing", "xmp"))


def indented(n: Node, out: Lines, first: str, rest: str) -> None:
    inner = Lines()
    render(n, inner)
    inner.flush()
    for i, row in enumerate(inner.done):
        deep = i > 0 and row.startswith(DEEPEST)
        out.put((first if i == 0 else "" if deep else rest) + row if row or i == 0 else " ")
        out.flush()
        if not row and i:
            out.done[-1] = ""


def items(n: Node, out: Lines) -> None:
    start = n.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for k in n.kids:
        if isinstance(k, str):
            if n.shown:
                out.text(k)
        elif not visible(k):
            continue
        elif k.tag == "li":
            if re.fullmatch(r"-?\d{1,9}", k.attrs.get("value", "")):
                number = int(k.attrs["value"])
            bullet = f"{number}. " if n.tag == "ol" else "- "
            number += 1
            out.gap(1)
            indented(k, out, bullet, " " * len(bullet))
            out.gap(1)
        else:
            wrap = Node(n.tag, shown=n.shown)
            wrap.kids = [k]
            render(wrap, out)
    out.flush()


def span(v: str, most: int) -> int:
    return max(1, min(most, int(v))) if re.fullmatch(r"\d{1,9}", v or "") else 1


def table(n: Node) -> list[str]:
    """A table's lines: its caption and other content first, then rows with their cells padded to columns."""
    lead, rows = Lines(), []
    busy: dict = {}  # column -> first row that no cell above reaches into

    def collect(m: Node) -> None:
        for k in m.kids:
            if isinstance(k, str):
                if m.shown:
                    lead.text(k)
            elif not visible(k):
                continue
            elif k.tag in ("tbody", "thead", "tfoot"):
                collect(k)
            elif k.tag == "tr":
                add(k)
            elif k.tag in ("td", "th"):
                one = Node("tr", shown=m.shown)
                one.kids = [k]
                add(one)
            elif k.tag not in ("col", "colgroup"):
                wrap = Node("div", shown=m.shown)
                wrap.kids = [k]
                lead.gap(1)
                render(wrap, lead)
                lead.gap(1)

    def add(tr: Node) -> None:
        cells: dict = {}
        at, r = 0, len(rows)
        for k in tr.kids:
            if isinstance(k, str):
                if tr.shown:
                    lead.text(k)
            elif not visible(k):
                continue
            else:
                while busy.get(at, 0) > r:
                    at += 1
                inner = Lines()
                render(k if k.tag in ("td", "th") else _only(k), inner)
                inner.flush()
                wide = span(k.attrs.get("colspan", ""), MAX_COLSPAN)
                cells[at] = (wide, inner.done)
                tall = span(k.attrs.get("rowspan", ""), MAX_ROWSPAN)
                if tall > 1:
                    for c in range(at, at + wide):
                        busy[c] = r + tall
                at += wide
        rows.append(cells)

    collect(n)
    lead.flush()
    out = [x for x in lead.done if x]
    edges = column_edges(rows)
    for cells in rows:
        for i in range(max((len(lines) for _, lines in cells.values()), default=0)):
            line = ""
            for at, (_, lines) in sorted(cells.items()):
                edge = edges[at]
                line = line.ljust(edge) if len(line) < edge else line + ("  " if line else "")
                line += lines[i] if i < len(lines) else ""
            out.append(line.rstrip())
    while out and not out[-1]:
        out.pop()
    return out


def column_edges(rows: list[dict]) -> list[int]:
    """Where each column begins: cells of one column set its width, and a cell over several widens the last of them where they are too narrow for it."""
    columns = max((at + wide for cells in rows for at, (wide, _) in cells.items()), default=0)
    text = sum(len(x) for cells in rows for _, lines in cells.values() for x in lines)
    heights = [max((len(lines) for _, lines in cells.values()), default=0) for cells in rows]
    most = max((len(x) for cells in rows for _, lines in cells.values() for x in lines), default=0)
    while True:
        width = [0] * columns
        used = [False] * columns
        spanning = []
        for cells in rows:
            for at, (wide, lines) in cells.items():
                longest = min(most, max(map(len, lines), default=0))
                if wide == 1:
                    width[at] = max(width[at], longest)
                elif longest:
                    spanning.append((wide, at, longest))
                used[at] = used[at] or longest > 0
        for wide, at, longest in sorted(spanning):
            have = sum(width[at : at + wide]) + 2 * (sum(used[at : at + wide]) - 1)
            if have < longest:
                width[at + wide - 1] += longest - have
        edges = [0]
        for w, u in zip(width, used):
            edges.append(edges[-1] + (w + 2 if u or w else 0))
        padded = sum(h * edges[max(cells)] for h, cells in zip(heights, rows) if cells)
        if padded <= PAD * text + PAD_FREE or most == 0:
            return edges
        most //= 2


def _only(k: Node) -> Node:
    wrap = Node("td", shown=k.shown)
    wrap.kids = [k]
    return wrap


def page_text(page: str) -> str:
    """All visible text of a page."""
    out = Lines()
    tree = build(page)
    # Python's own calls need no C stack: a page may nest as deeply as it has tags
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 6 * page.count("<")))
    render(tree, out)
    out.flush()
    rows = out.done
    while rows and not rows[-1]:
        rows.pop()
    first = next((i for i, r in enumerate(rows) if r), len(rows))
    return "\n".join(rows[first:])


def extracted(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages' columns (or `keep`) and, last, `text` (underscores before the name if taken). A narrow transformation."""
    keep = pages.columns if keep is None else keep

    def run(docs):
        return {"text": pa.array([None if d is None else page_text(d.decode("utf-8", "replace")) for d in docs], pa.string())}

    made = map_texts(pages, html_col, keep, run, T.StructType([T.StructField("text", T.StringType())]))
    return made.toDF(*keep, free_name(pages.select(*[F.col(f"`{c}`") for c in keep]), "text"))


def op10_layout_text(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])

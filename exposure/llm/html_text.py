"""HTML as text, laid out as it would be seen: blocks, lists and tables keep their form, invisible parts are left out.

1. Tokens: tags, comments, raw text elements (script, style, ...) and text, by one pattern.
2. Tree: tags that HTML implies are added (a paragraph ends where a block begins, a list item or cell where the next begins, a cell outside a row begins one), end tags
   without a start are ignored, and what is open at the end is closed. The tree is built and walked without recursion, so depth is unbounded.
3. Visibility: HIDDEN elements, ``hidden`` and ``aria-hidden="true"``, and inline styles ``display:none`` and ``visibility:hidden`` take their content out. Form
   controls show their value or label, images their alternative text.
4. Layout: runs of white space are one space, but kept in ``pre`` and ``textarea``. A block stands on lines of its own; paragraphs, headings, lists, tables and the like have an
   empty line around them. List items have a mark and are indented by depth; cells of a table are aligned in columns joined by `` | ``. What else stands in a table,
   its sections or its rows is shown behind it.

Defined cases: a null page is empty text; broken or unclosed tags are text or closed as above, and nothing raises; each row gives one row, repeated rows and null ids
too; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.common import kind_of, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object noembed noframes xmp".split())
ESCAPABLE = frozenset("title textarea".split())
HIDDEN = frozenset("head script style noscript template iframe object noembed noframes datalist title audio video canvas".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td text textarea tfoot th thead tr ul caption".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third is nearer.
ENDS_PARAGRAPH = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot caption option optgroup legend summary text".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
HEAD_ONLY = frozenset("head meta title link base style script noscript template html".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: Where a form stays empty, and where a table ends the one that it stands in.
TABLE_PARTS = SECTIONS | {"table", "tr"}
#: In svg and math: not shown by a browser. There alone a tag may close itself.
FOREIGN_HIDDEN = frozenset("annotation annotation-xml desc metadata".split())
UNQUOTED_END = re.compile(r"""=\s*[^\s"'=]+\Z""")
#: An end tag looks no further than these.
SCOPES = frozenset("table td th caption html button".split())

#: Every alternative may end at the end of the page, and quoted values are not tried twice, so a search is linear in the page.
TAG = re.compile(r"""<!--(?P<comment>.*?)(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
WHITE = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        out.setdefault(m[1].lower(), html.unescape(value or ""))
    return out


def tree(page: str) -> Node:
    root = Node("#root")
    stack, at = [root], 0
    is_open: Counter[str] = Counter()

    def close(i: int) -> None:
        for node in stack[i:]:
            is_open[node.name] -= 1
        del stack[i:]

    def text(s: str) -> None:
        if s:
            if stack[-1].name in ("head", "colgroup") and s.strip():
                close(len(stack) - 1)
            stack[-1].children.append(s)

    def end(names: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> None:
        """Close the nearest of ``names`` and all in it, unless a barrier is nearer; repeated, since several may be open."""
        while any(is_open[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    close(i)
                    break
                if stack[i].name in barriers:
                    return
            else:
                return

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            text(html.unescape(page[at:]))
            break
        text(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "br":
                stack[-1].children.append(Node("br"))
                continue
            barriers = SCOPES - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else {"table"} - {name}
            for i in range(len(stack) - 1, 0, -1) if is_open[name] else ():
                if stack[i].name == name:
                    close(i)
                    break
                if stack[i].name in barriers:
                    break
            continue
        if stack[-1].name == "head" and name not in HEAD_ONLY:
            close(len(stack) - 1)
        if name in ENDS_PARAGRAPH:
            end({"p"}, SCOPES)
        if stack[-1].name == "colgroup" and name not in ("col", "template"):
            close(len(stack) - 1)
        if name in IMPLIED:
            end(*IMPLIED[name])
        if name == "table" and stack[-1].name in TABLE_PARTS:
            end({"table"}, set())
        if name in ("td", "th") and stack[-1].name in TABLE_PARTS - {"tr"}:
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
            is_open["tr"] += 1
        node = Node(name, attributes_of(m["attributes"]) if m["attributes"].strip() else {})
        stack[-1].children.append(node)
        foreign = (is_open["svg"] or is_open["math"]) and not is_open["foreignobject"]
        if foreign and name in FOREIGN_HIDDEN:
            node.attributes["hidden"] = ""
        if name == "form" and stack[-1].name in TABLE_PARTS:
            continue
        if (foreign or name in ("svg", "math")) and m["attributes"].endswith("/") and not UNQUOTED_END.search(m["attributes"]):
            continue
        if name in RAW or name in ESCAPABLE:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inside = page[at : stop.start() if stop else len(page)]
            at = stop.end() if stop else len(page)
            node.children.append(html.unescape(inside) if name in ESCAPABLE else inside)
        elif name not in VOID:
            stack.append(node)
            is_open[name] += 1
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    if node.name in HIDDEN:
        return False
    if not a:
        return True
    return not ("hidden" in a and a["hidden"] != "until-found") and a.get("aria-hidden", "").lower() != "true" and not INVISIBLE.search(a.get("style", "")) and not (node.name == "input" and a.get("type", "").lower() == "hidden")


class Lines:
    """Lines under construction. ``gap`` is what must stand before the next text: 0 nothing, 1 a new line, 2 an empty line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.indent, self.mark = "", 0, False, 0, ""

    def block(self, gap: int) -> None:
        if self.line.strip(" ") or self.line and self.mark == "":
            self.lines.append(self.line.rstrip(" "))
        self.line, self.space = "", False
        self.gap = max(self.gap, gap) if self.lines else 0

    def start(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            self.line = "  " * self.indent + self.mark
            if self.mark:
                self.mark = ""

    def words(self, s: str) -> None:
        parts = WHITE.split(s)
        if len(parts) == 1 and not parts[0]:
            return
        lead, trail = s[0] in " \t\n\r\f", s[-1] in " \t\n\r\f"
        body = " ".join(p for p in parts if p)
        if not body:
            self.space = bool(self.line)
            return
        if (lead or self.space) and self.line and not self.line.endswith(" "):
            self.line += " "
        self.start()
        self.line += body
        self.space = trail

    def kept(self, s: str) -> None:
        """Preformatted text, line by line."""
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.start()
            self.line += first
        for part in rest:
            self.lines.append(self.line)
            self.line, self.gap = "", 0
            if part:
                self.start()
                self.line += part

    def text(self) -> str:
        if self.line:
            self.lines.append(self.line.rstrip(" "))
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        while self.lines and not self.lines[0].strip():
            self.lines.pop(0)
        return "\n".join(self.lines)


def width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s) if not s.isascii() else len(s)


def rows_of(table: Node) -> list[list[Node]]:
    rows: list[list[Node]] = []
    todo: list[Node] = [table]
    while todo:
        node = todo.pop()
        if node.name == "tr":
            rows.append([c for c in node.children if isinstance(c, Node) and c.name in ("td", "th") and visible(c)])
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and (c.name == "tr" or c.name in SECTIONS and node is table) and visible(c)]
    return rows


def loose_of(table: Node) -> list[Node | str]:
    """What stands in a table, its sections or its rows and is neither caption nor cell, in order; an empty block parts what has not the same parent."""
    out: list[Node | str] = []
    last = None
    todo: list[tuple[Node | str, Node]] = [(c, table) for c in reversed(table.children)]
    while todo:
        c, parent = todo.pop()
        if isinstance(c, str):
            if not c.strip() and parent is not last:
                continue
        elif c.name == "tr" and parent.name != "tr" or c.name in SECTIONS and parent is table:
            if visible(c):
                todo += [(x, c) for x in reversed(c.children)]
            continue
        elif c.name in ("td", "th") and parent.name == "tr" or c.name in ("caption", "colgroup", "col") and parent is table:
            continue
        if out and parent is not last:
            out.append(Node("div"))
        out.append(c)
        last = parent
    return out


def aligned(rows: list[list[list[str]]], spans: list[list[int]]) -> list[str]:
    """Rows of cells (each some lines) in columns; a cell that spans columns takes part in no column's width."""
    widths: dict[int, int] = {}
    for cells, across in zip(rows, spans):
        at = 0
        for lines, n in zip(cells, across):
            if n == 1:
                widths[at] = max([widths.get(at, 0), *map(width, lines)])
            at += n
    out = []
    for cells, across in zip(rows, spans):
        for k in range(max([1, *map(len, cells)]) if cells else 0):
            at, parts = 0, []
            for lines, n in zip(cells, across):
                room = sum(widths.get(at + i, 0) for i in range(n)) + 3 * (n - 1)
                s = lines[k] if k < len(lines) else ""
                parts.append(s + " " * (room - width(s)))
                at += n
            line = " | ".join(parts).rstrip(" ")
            if line.strip(" |"):
                out.append(line)
    return out


def span_of(cell: Node) -> int:
    value = cell.attributes.get("colspan", "1").strip()
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def render(root: Node) -> str:
    """A walk with a stack of its own; a table's cells are rendered first, each as text."""
    done: dict[int, str] = {}
    work: list[tuple[Node, bool]] = [(root, False)]
    while work:
        top, ready = work[-1]
        tables = [] if ready else inner_tables(top)
        if tables:
            work[-1] = (top, True)
            work += [(cell, False) for t in tables for row in rows_of(t) for cell in row] + [(c, False) for t in tables for c in t.children if isinstance(c, Node) and c.name == "caption" and visible(c)]
            continue
        work.pop()
        done[id(top)] = flow(top, done)
    return done[id(root)]


def inner_tables(top: Node) -> list[Node]:
    out, todo = [], [c for c in top.children if isinstance(c, Node)]
    while todo:
        node = todo.pop()
        if visible(node):
            if node.name == "table":
                out.append(node)
            todo += [c for c in (loose_of(node) if node.name == "table" else node.children) if isinstance(c, Node)]
    return out


def flow(top: Node, done: dict[int, str]) -> str:
    out = Lines()
    # (node or text, what to do: enter, leave), with the state of lists and of preformatted text
    work: list[tuple[object, str]] = [(c, "enter") for c in reversed(top.children)]
    lists: list[list] = []
    pre = 1 if top.name == "pre" else 0
    while work:
        node, step = work.pop()
        if isinstance(node, str):
            out.kept(node) if pre else out.words(node)
            continue
        name = node.name
        if step == "leave":
            if name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                out.indent = max(len(lists) - 1, 0)
            if name in ("pre", "textarea"):
                pre -= 1
            if name in ("blockquote", "dd"):
                out.indent -= 1
            if name == "li":
                out.block(1)
                out.mark = ""
            elif name == "q":
                out.words('"')
            else:
                out.block(2 if name in SPACED and not (lists and name in ("ul", "ol", "menu")) else 1)
            continue
        if not visible(node):
            continue
        if name == "br":
            if out.line:
                out.lines.append(out.line.rstrip(" "))
                out.line, out.space = "", False
            elif out.lines and out.lines[-1] != "" and out.gap == 0:
                out.lines.append("")
            continue
        if name == "hr":
            out.block(2)
            out.start()
            out.line += "---"
            out.block(2)
            continue
        if name == "img":
            out.words(node.attributes.get("alt", ""))
            continue
        if name == "input":
            if node.attributes.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "image"):
                out.words(node.attributes.get("value") or node.attributes.get("placeholder", ""))
            continue
        if name == "table":
            out.block(2)
            caption = [done[id(c)] for c in node.children if isinstance(c, Node) and c.name == "caption" and id(c) in done]
            cells = rows_of(node)
            body = aligned([[done[id(c)].split("\n") for c in row] for row in cells], [[span_of(c) for c in row] for row in cells])
            for line in [*(x for c in caption if c for x in c.split("\n")), *body]:
                out.start()
                out.line += line
                out.block(1)
            loose = loose_of(node)
            out.block(2)
            if loose:
                work += [(node, "leave"), *((c, "enter") for c in reversed(loose))]
            continue
        if name in BLOCKS:
            if name in ("ul", "ol", "menu", "dir"):
                out.block(1 if lists else 2)
                start = node.attributes.get("start", "1")
                lists.append([name, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                out.indent = len(lists) - 1
            elif name == "li":
                out.block(1)
                ordered = bool(lists) and lists[-1][0] == "ol"
                out.mark = f"{lists[-1][1]}. " if ordered else "- "
                if ordered:
                    lists[-1][1] += 1
            else:
                out.block(0 if out.mark and not out.line else 2 if name in SPACED else 1)
            if name in ("blockquote", "dd"):
                out.indent += 1
            if name in ("pre", "textarea"):
                pre += 1
            work.append((node, "leave"))
        elif name == "q":
            out.words('"')
            work.append((node, "leave"))
        work += [(c, "enter") for c in reversed(node.children)]
    return out.text()


def page_text(page: str) -> str:
    return render(tree(page))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col and text: one row for each page, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([page_text(p) for p in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    rows = pages.select(pages[id_col].alias("id"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {kind_of(pages, id_col)}, text string")

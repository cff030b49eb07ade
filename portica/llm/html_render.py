"""Layout-aware rendering of HTML to text.

A tokenizer feeds a tree builder that closes elements whose end tags may be left out (p, li, dt, dd, tr,
td, th, option, table sections) and knows void and raw-text elements.  Rendering walks the tree: hidden
elements give nothing, blocks are set apart by line breaks, lists get markers and indents, table cells
are padded to their columns, and white space collapses except in pre.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element classes and implied end tags of the HTML standard.
SECTIONS = ("thead", "tbody", "tfoot")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript noframes iframe object audio video canvas title meta link datalist".split())
# Of svg and math: what is described, defined or annotated, but not drawn.
FOREIGN_UNSEEN = frozenset("desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tr ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup tr caption legend summary".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_GAP = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_NUMBER = re.compile(r"\s*([0-9]{1,6})")
#: Columns or rows that one cell spans, at most, as browsers have it.
MAX_SPAN = 1000
#: Of the bounded layout alone: tables in tables that are aligned; blanks and bars of a padded table against what it holds.
ALIGNED, LOOSE = 4, 3
#: Characters of text in one batch of rows, but for a page that has more.
BATCH_CHARS = 1 << 24


class Node:
    """`foreign` is svg or math for what stands in one, else empty."""

    __slots__ = ("tag", "attrs", "kids", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: str = ""):
        self.tag, self.attrs, self.kids, self.foreign = tag, attrs, [], foreign


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


class Stack(list):
    """The open elements, and how many of each tag are open, so that no scan looks for one that is not there."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] += 1

    def cut(self, at: int) -> None:
        self.open.subtract(n.tag for n in self[at:])
        del self[at:]


def build_tree(html: str) -> Node:
    root = Node("#root", {})
    stack = Stack(root)
    at = 0
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            if stack[-1].tag == "colgroup" and text.strip():
                stack.cut(len(stack) - 1)
            stack[-1].kids.append(unescape(text))
        if not m:
            return root
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            _end(stack, tag)
            continue
        _imply(stack, tag)
        foreign = tag if tag in ("svg", "math") else "" if stack[-1].tag == "foreignobject" else stack[-1].foreign
        node = Node(tag, _attributes(m[3]) if m[3] and not m[3].isspace() else {}, foreign)
        stack[-1].kids.append(node)
        if tag in VOID or foreign and m[3].endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            body = html[at : close.start()] if close else html[at:]
            node.kids.append(unescape(body) if tag in ("textarea", "title") else body)
            at = close.end() if close else len(html)
            continue
        stack.push(node)


def _end(stack: Stack, tag: str) -> None:
    if not stack.open[tag]:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            stack.cut(i)
            return
        if stack[i].tag == "table" and tag != "table" and tag not in ("body", "html"):
            return


def _imply(stack: Stack, tag: str) -> None:
    if tag in CLOSES_P and stack.open["p"]:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                stack.cut(i)
                break
            if stack[i].tag in ("td", "th", "table", "li", "div", "button"):
                break
    closes, scope = IMPLIED.get(tag, ((), ()))
    if any(stack.open[t] for t in closes):
        cut = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in closes:
                cut = i
        if cut:
            stack.cut(cut)
    if stack[-1].tag == "colgroup" and tag not in ("col", "template"):
        stack.cut(len(stack) - 1)
    if tag in ("td", "th") and stack[-1].tag in ("table", *SECTIONS):
        row = Node("tr", {})
        stack[-1].kids.append(row)
        stack.push(row)


def _shown(node: Node) -> bool:
    """False for elements that take no place, nor does anything in them."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or node.foreign and node.tag in FOREIGN_UNSEEN:
        return False
    if node.tag == "input" or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _NOT_SHOWN.search(a["style"]))


def _veiled(node: Node, outside: bool) -> bool:
    """Whether text in a node is kept invisible; a node inside may be visible again."""
    found = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return found[-1].lower() != "visible" if found else outside


def _span(node: Node, name: str) -> int:
    found = _NUMBER.match(node.attrs.get(name, ""))
    return min(max(int(found[1]), 1), MAX_SPAN) if found else 1


class _Page:
    """Lines of output; `space` is a pending blank, `gap` the line breaks due before the next text."""

    def __init__(self, bounded: bool, depth: int = 0):
        self.out: list[str] = []
        self.bounded, self.depth = bounded, depth
        self.gap, self.space, self.fresh, self.indent = 0, False, True, ""

    def break_(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def trim(self) -> None:
        """Takes white space off the end of the last line."""
        while self.out and not self.out[-1].endswith("\n"):
            if bare := self.out[-1].rstrip():
                self.out[-1] = bare
                return
            self.out.pop()

    def put(self, text: str) -> None:
        if self.gap or not self.out:
            if self.out:
                self.trim()
                self.out.append("\n" * self.gap)
            self.out.append(self.indent)
            self.gap, self.fresh = 0, True
        elif self.space and not self.fresh:
            self.out.append(" ")
        self.space = False
        self.out.append(text)
        self.fresh = False

    def lines(self, text: str) -> None:
        """Lines without white space at their ends."""
        self.break_(1)
        if self.indent:
            text = "\n".join(line and self.indent + line for line in text.split("\n")).removeprefix(self.indent)
        self.put(text)

    def words(self, text: str) -> None:
        bare = _GAP.sub(" ", text)
        if bare.startswith(" "):
            self.space = True
        if core := bare.strip(" "):
            self.put(core)
            self.space = bare.endswith(" ")

    def text(self) -> str:
        self.trim()
        return "".join(self.out).strip("\n")


def _walk(first) -> None:
    """Runs a generator and those it yields, each before what follows it; depth costs no Python frames."""
    stack = [first]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _render(node: Node, page: _Page, pre: bool, veil: bool = False):
    marker = 0
    if node.tag == "ol":
        start = node.attrs.get("start", "")
        marker = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for kid in node.kids:
        if isinstance(kid, str):
            if veil:
                page.space = page.space or not pre
            elif pre:
                for i, line in enumerate(kid.replace("\r\n", "\n").split("\n")):
                    if i:
                        page.gap += 1
                    if line:
                        page.put(line)
            else:
                page.words(kid)
            continue
        if not _shown(kid):
            continue
        tag, hid = kid.tag, _veiled(kid, veil)
        if tag == "br":
            page.gap += 1
            page.space = False
        elif tag == "hr":
            page.break_(1)
            if not hid:
                page.put("---")
            page.break_(1)
        elif tag == "img":
            if (alt := kid.attrs.get("alt", "").strip()) and not hid:
                page.words(f" {alt} ")
        elif tag == "table":
            page.break_(2)
            yield _table(kid, page, hid)
            page.break_(2)
        elif tag == "li":
            page.break_(1)
            mark = f"{marker}. " if node.tag == "ol" else "- "
            marker += 1
            if not hid:
                page.put(mark)
                page.fresh = True
            kept, page.indent = page.indent, page.indent + " " * len(mark)
            yield _render(kid, page, pre, hid)
            page.indent = kept
            page.break_(1)
        elif tag in BLOCK:
            lines = 2 if tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li") else 1
            page.break_(lines)
            kept = page.indent
            if tag in ("blockquote", "dd"):
                page.indent += "  "
            yield _render(kid, page, pre or tag == "pre", hid)
            page.indent = kept
            page.break_(lines)
        elif tag == "text" and kid.foreign:
            page.space = True  # labels of a drawing stand apart
            yield _render(kid, page, pre, hid)
            page.space = True
        else:
            yield _render(kid, page, pre or tag == "textarea", hid)


def _parts(table: Node, veil: bool):
    """(what stands in a table or in one of its sections, whether it is veiled there), in order."""
    for kid in table.kids:
        if isinstance(kid, Node) and kid.tag in SECTIONS:
            if _shown(kid):
                hid = _veiled(kid, veil)
                yield from ((x, hid) for x in kid.kids)
        else:
            yield kid, veil


def _cells(row: Node, veil: bool):
    """(cell, whether it is veiled) of a row; what stands in a row outside cells is a cell too."""
    for kid in row.kids:
        if isinstance(kid, Node) and kid.tag in ("td", "th"):
            if _shown(kid):
                yield kid, _veiled(kid, veil)
        elif isinstance(kid, Node) or kid.strip():
            loose = Node("#cell", {})
            loose.kids.append(kid)
            yield loose, veil


def _rows(table: Node, veil: bool):
    for row, hid in _parts(table, veil):
        if isinstance(row, Node) and row.tag == "tr" and _shown(row):
            yield row, _veiled(row, hid)


def _table(table: Node, page: _Page, veil: bool):
    """Cells padded to their columns; what stands in a table or a section outside rows comes before it.

    A cell that spans rows or columns leaves the places that it takes empty, as far as the widest row has cells.
    The bounded layout departs from that by size: a table whose blanks and bars would be more than LOOSE times what
    it holds is not padded and has no empty places, and tables more than ALIGNED deep in others have a line for each
    cell, so no text is copied more often than that.
    """
    for kid, hid in _parts(table, veil):
        loose = Node("#loose", {})
        if isinstance(kid, str) and kid.strip() or isinstance(kid, Node) and kid.tag not in ("tr", "colgroup", "col"):
            loose.kids.append(kid)
            yield _render(loose, page, False, hid)
            page.break_(1)
    if page.bounded and page.depth >= ALIGNED:
        for row, hid in _rows(table, veil):
            for cell, cell_hid in _cells(row, hid):
                page.break_(1)
                yield _render(cell, page, False, cell_hid)
                page.break_(1)
        return
    rows = [list(_cells(row, hid)) for row, hid in _rows(table, veil)]
    widest = max(map(len, rows), default=0)
    grid: list[list[str]] = []
    taken: dict[int, int] = {}  # columns that cells of rows above still take, with the rows that are left
    held = 0
    for row in rows:
        cells: list[str] = []
        below: dict[int, int] = {}
        for cell, hid in row:
            while taken.get(len(cells), 0):
                cells.append("")
            wide, tall = max(min(_span(cell, "colspan"), widest - len(cells)), 1), _span(cell, "rowspan")
            if tall > 1:
                below.update((len(cells) + j, tall - 1) for j in range(wide))
            inner = _Page(page.bounded, page.depth + 1)
            yield _render(cell, inner, False, hid)
            text = inner.text()
            held += len(text) + 8
            cells += [text, *[""] * (wide - 1)]
        taken = {j: n - 1 for j, n in taken.items() if n > 1} | below
        if any(cells):
            grid.append(cells)
    if max(map(len, grid), default=0) == 1:
        for (cell,) in grid:
            page.lines(cell)
        page.break_(1)
        return
    split = [[c.split("\n") for c in cells] for cells in grid]
    width: list[int] = []
    for cells in split:
        width.extend([0] * (len(cells) - len(width)))
        for j, cell in enumerate(cells):
            width[j] = max(width[j], *map(len, cell))
    before = [0]
    for w in width:
        before.append(before[-1] + w + 3)
    padded = not page.bounded or sum(before[len(cells)] * max(map(len, cells)) for cells in split) <= LOOSE * held + 400
    for cells in split:
        tall = range(max(map(len, cells)))
        if padded:
            blanks = [*width[: len(cells) - 1], 0]  # none behind the last cell
            page.lines("\n".join(" | ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(cells, blanks, strict=True)).rstrip() for i in tall))
        else:
            page.lines("\n".join(" | ".join(c[i] for c in cells if i < len(c) and any(c)) for i in tall))
    page.break_(1)


def render(html: str | None, bounded: bool = True) -> str:
    """All visible text of a page; null and empty give ''.

    Not bounded, all tables are aligned by one rule, whatever their size and depth; blanks of a table may then be the
    square of its page. Bounded, the text is about as long as the page, for pages that are not trusted.
    """
    if not html:
        return ""
    page = _Page(bounded)
    _walk(_render(build_tree(html), page, False))
    return page.text()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bounded: bool = False) -> DataFrame:
    """(id, text, n_chars, n_lines) for each page; no shuffle. `bounded` as in `render`.

    Null or empty html gives '' with zero lines. Malformed markup never fails, however deep: what cannot be
    parsed as a tag is text, as is a tag whose attribute lacks its closing quote. What closed <details> hold
    is shown; rules of <style> are not read. Repeated rows and null ids pass through, an empty table gives no rows; other
    columns are not read, so their names may clash with any of these.
    """
    narrow = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, at, texts, size = batch.column("id"), 0, [], 0
            for h in batch.column("html").to_pylist():
                texts.append(render(h, bounded))
                size += len(texts[-1])
                if size >= BATCH_CHARS or at + len(texts) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array(texts, pa.string())], names=["id", "text"])
                    at, texts, size = at + len(texts), [], 0

    out = narrow.mapInArrow(run, f"id {kind}, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.select(F.col("id").alias(id_col), "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))

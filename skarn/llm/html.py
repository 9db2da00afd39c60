"""Visible text of web pages: a tree with implied tags, visibility rules, and a layout of blocks, lists and tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without content, without rendering, and with line or paragraph breaks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("area audio base canvas datalist head iframe link meta noembed noframes noscript object param rp script source style svg template title track video".split())
BLOCKS = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
TABLE_PARTS = frozenset("caption colgroup tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Fixed values of the HTML standard: the greatest spans of a cell.
WIDEST, DEEPEST = 1000, 65534
#: What the start of an element closes, up to the nearest of the elements after it.
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    **{t: (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})) for t in ("tbody", "thead", "tfoot")},
    "body": (frozenset({"head"}), frozenset()),
}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
SPACES = re.compile(r"[ \t\n\r\f]+")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMMENT = re.compile(r"(?s)/\*.*?(?:\*/|\Z)")
SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)", re.I)
#: Signs by which nested lists and quotations are set in at most; widest cell that others of its column are padded to;
#: tables inside one another whose cells are still aligned, the cells of deeper ones being blocks. No text is lost.
INDENT, PAD, NESTED = 80, 200, 40


class Node:
    """An element and its children, which are nodes or strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Builds the tree; missing and misplaced end tags are put right the way browsers do in the common cases."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open, self.count = [self.root], Counter()

    def _cut(self, at: int) -> None:
        self.count.subtract(n.tag for n in self.open[at:])
        del self.open[at:]

    def _close(self, tags: frozenset[str], until: frozenset[str]) -> None:
        """Close the outermost of ``tags`` that is open above the nearest of ``until``."""
        if not any(self.count[t] for t in tags):
            return
        at = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in until:
                break
            if self.open[i].tag in tags:
                at = i
        if at is not None:
            self._cut(at)

    def _end_head(self) -> None:
        if self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag not in IN_HEAD:
            self._end_head()
        if tag in BLOCKS or tag in TABLE_PARTS:
            self._close(frozenset({"p"}), frozenset({"td", "th", "table", "button", "caption"}))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.count["p"]:
            self._end_head()
            self.open[-1].children.append(Node(tag, {}))
            return
        if not any(self.count[t] for t in (HEADINGS if tag in HEADINGS else (tag,))):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag or tag in HEADINGS and self.open[i].tag in HEADINGS:
                self._cut(i)
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                return

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head()
        self.open[-1].children.append(data)


def css_rules(text: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet; what is inside at-rules, as for print, is left out."""
    text, depth, start, told = COMMENT.sub(" ", text), 0, 0, ""
    for m in re.finditer("[{};]", text):
        if m[0] == "{":
            depth += 1
            if depth == 1:
                told, start = text[start : m.start()].strip(), m.end()
        elif m[0] == "}":
            if depth == 1 and told and not told.startswith("@"):
                yield told, text[start : m.start()]
            depth = max(0, depth - 1)
            if not depth:
                start = m.end()
        elif not depth:
            start = m.end()


class Styles:
    """Display and visibility of elements: simple selectors of a page's style sheets, style and hidden attributes."""

    def __init__(self, root: Node) -> None:
        #: By id, class or element: (rank, element, ids, classes, property, value).
        self.rules: dict[str, list[tuple]] = {}
        waiting, n = [root], 0
        while waiting:
            for child in reversed((node := waiting.pop()).children):
                if isinstance(child, Node):
                    waiting.append(child)
            if node.tag == "style":
                for selectors, declared in css_rules("".join(c for c in node.children if isinstance(c, str))):
                    for name, value, important in DECLARED.findall(declared):
                        n += 1
                        for selector in selectors.split(","):
                            self._add(selector.strip(), name.lower(), value.lower(), bool(important), n)

    def _add(self, selector: str, name: str, value: str, important: bool, order: int) -> None:
        found = SELECTOR.fullmatch(selector)
        if not selector or not found:
            return
        tag, parts = (found[1] or "*").lower(), re.findall(r"[.#][\w-]+", found[2])
        ids, classes = {p[1:] for p in parts if p[0] == "#"}, {p[1:] for p in parts if p[0] == "."}
        rank = (important, False, len(ids), len(classes), tag != "*", order)
        self.rules.setdefault(parts[0] if parts else tag, []).append((rank, tag, ids, classes, name, value))

    def of(self, node: Node) -> tuple[bool, bool | None]:
        """Whether the element is rendered, and whether it is visible (None: as its parent)."""
        attrs, tag = node.attrs, node.tag
        if tag in UNSEEN or tag == "input" or tag == "dialog" and "open" not in attrs:
            return False, None
        if not attrs and not self.rules:
            return True, None
        best: dict[str, tuple] = {"display": ((False,), "none")} if "hidden" in attrs else {}
        if self.rules:
            mine, my_id = set((attrs.get("class") or "").split()), attrs.get("id") or ""
            for key in (tag, "*", "#" + my_id, *("." + c for c in mine)):
                for rank, wanted, ids, classes, name, value in self.rules.get(key, ()):
                    if wanted in ("*", tag) and ids <= {my_id} and classes <= mine and (name not in best or best[name][0] < rank):
                        best[name] = rank, value
        if attrs.get("style"):
            for name, value, important in DECLARED.findall(attrs["style"]):
                rank = (bool(important), True)
                if name.lower() not in best or best[name.lower()][0] <= rank:
                    best[name.lower()] = rank, value.lower()
        shown = {"hidden": False, "collapse": False, "visible": True}.get(best["visibility"][1]) if "visibility" in best else None
        return "display" not in best or best["display"][1] != "none", shown


class Lines:
    """Lines of text with collapsed spaces, single breaks, at most one blank line between blocks, and nested prefixes."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = False
        self.begun = 0
        #: Indentation inside each open prefix, and the prefixes that no line has shown yet.
        self.indents, self.pending, self.outer = [""], [], ""

    def text(self, data: str) -> None:
        if not data:
            return
        words = SPACES.sub(" ", data)
        bare = words.strip(" ")
        if bare:
            if self.now and (self.space or words[0] == " "):
                self.now.append(" ")
            self.now.append(bare)
            self.space = words[-1] == " "
        else:
            self.space = True

    def raw(self, data: str) -> None:
        """Preformatted text: spaces and breaks count."""
        for i, line in enumerate(data.split("\n")):
            if i:
                self.put("".join(self.now))
            if line:
                self.now.append(line)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        prefix = self.indents[-1] if line else ""
        if self.pending:
            prefix = self.outer + "".join(self.pending)
            self.pending.clear()
        self.lines.append(prefix + line)
        self.now, self.space, self.blank = [], False, False

    def line(self) -> None:
        """End the line, if it has begun."""
        if self.now:
            self.put("".join(self.now))
        self.space = False

    def gap(self) -> None:
        """End the line, and leave a blank one before what follows, unless nothing of the nested block came yet."""
        self.line()
        self.blank = self.blank or len(self.lines) > self.begun

    def nest(self, mark: str, rest: str, gap: bool) -> Callable[[], None]:
        """Begin a block whose first line starts with ``mark`` and whose others are set in; what is returned ends it."""
        (self.gap if gap else self.line)()
        if not self.pending:
            self.outer = self.indents[-1]
        self.pending.append(mark)
        self.indents.append((self.indents[-1] + rest)[:INDENT])
        before, self.begun = self.begun, len(self.lines)
        start = self.begun

        def end() -> None:
            self.line()
            self.indents.pop()
            if self.pending:
                self.pending.pop()
            if len(self.lines) > start:
                self.blank = False
            self.begun = before
            if gap:
                self.gap()

        return end

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _wide(text: str) -> int:
    return len(text) if text.isascii() else sum(1 + (east_asian_width(c) in "WF") for c in text)


def _number(node: Node, name: str, default: int | None = None) -> int | None:
    """The integer that an attribute starts with."""
    found = re.match(r"\s*([+-]?[0-9]{1,18})", node.attrs.get(name) or "", re.A)
    return int(found[1]) if found else default


def _span(cell: Node, name: str, most: int) -> int:
    """A cell's span within the standard's limits; zero rows are all that are left of the group."""
    n = _number(cell, name, 1)
    return most if n == 0 and name == "rowspan" else min(n, most) if n > 0 else 1


class Layout:
    """Renders a node's children into lines; open elements are a list, so that no depth of a page exhausts the stack."""

    def __init__(self, styles: Styles) -> None:
        self.styles = styles

    def block(self, node: Node, shown: bool = True, pre: bool = False, depth: int = 0) -> list[str]:
        out = Lines()
        nothing = lambda: None
        #: Children, element, whether spaces count, visibility, what ends it, [next number, step].
        frames = [(iter(node.children), node, pre, shown, nothing, [1, 1])]
        while frames:
            children, parent, pre, shown, leave, numbers = frames[-1]
            child = next(children, None)
            if child is None:
                frames.pop()
                leave()
                continue
            if isinstance(child, str):
                if shown:
                    (out.raw if pre else out.text)(child)
                continue
            rendered, visible = self.styles.of(child)
            if not rendered:
                continue
            seen, tag, inside, leave = shown if visible is None else visible, child.tag, child.children, nothing
            if tag == "br":
                if seen:
                    out.put("".join(out.now).rstrip(" "))
                continue
            if tag == "hr":
                out.gap()
                continue
            if tag == "table" and depth < NESTED:
                out.gap()
                for line in self.table(child, seen, depth + 1):
                    out.put(line)
                out.gap()
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                leave = out.nest("  ", "  ", False) if parent.tag == "li" else out.nest("", "", True)
            elif tag == "li":
                number = _number(child, "value", numbers[0])
                numbers[0] = number + numbers[1]
                mark = f"{number}. " if parent.tag == "ol" else "- "
                leave = out.nest(mark, " " * len(mark), False)
            elif tag in ("dd", "blockquote"):
                leave = out.nest("  ", "  ", tag == "blockquote")
            elif tag in BLOCKS or tag in TABLE_PARTS:
                leave = out.gap if tag in SPACED else out.line
                leave()
            if tag == "details" and "open" not in child.attrs:
                inside = next(([c] for c in inside if isinstance(c, Node) and c.tag == "summary"), [])
            if tag == "textarea" and inside and isinstance(inside[0], str):
                inside = [inside[0].removeprefix("\n"), *inside[1:]]
            step, start = 1, 1
            if tag == "ol":
                back = "reversed" in child.attrs
                step = -1 if back else 1
                start = _number(child, "start", sum(isinstance(c, Node) and c.tag == "li" for c in inside) if back else 1)
            frames.append((iter(inside), child, pre or tag in ("pre", "textarea"), seen, leave, [start, step]))
        return out.done()

    def table(self, node: Node, shown: bool, depth: int) -> list[str]:
        """Caption, then rows whose cells are padded to the width of their column and set off by bars."""
        rows: list[dict[int, list[str]]] = []
        before: list[str] = []
        held: dict[int, int] = {}

        def row(cells: Iterator[tuple[Node | str, bool]]) -> None:
            found: dict[int, list[str]] = {}
            at = 0
            for cell, seen in cells:
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    beside(cell, seen)
                    continue
                while held.get(at, 0) > 0:
                    at += 1
                found[at] = [x for x in self.block(cell, seen, depth=depth) if x]
                span, deep = _span(cell, "colspan", WIDEST), _span(cell, "rowspan", DEEPEST)
                if deep > 1:
                    held.update(dict.fromkeys(range(at, at + span), deep))
                at += span
            for column in [c for c, n in held.items() if n > 0]:
                held[column] -= 1
            rows.append(found)

        def beside(part: Node | str, seen: bool) -> None:
            if isinstance(part, Node):
                before.extend(self.block(part, seen, depth=depth))
            elif seen and part.strip():
                before.append(SPACES.sub(" ", part).strip())

        def within(part: Node, seen: bool) -> Iterator[tuple[Node | str, bool]]:
            for child in part.children:
                if isinstance(child, str):
                    yield child, seen
                    continue
                rendered, visible = self.styles.of(child)
                if rendered:
                    yield child, seen if visible is None else visible

        parts = [within(node, shown)]
        while parts:
            child, seen = next(parts[-1], (None, shown))
            if child is None:
                parts.pop()
                held.clear()
            elif isinstance(child, str) or child.tag not in ("tbody", "thead", "tfoot", "colgroup", "tr", "td", "th"):
                beside(child, seen)
            elif child.tag == "tr":
                row(within(child, seen))
            elif child.tag in ("td", "th"):
                row(iter([(child, seen)]))
            else:
                held.clear()
                parts.append(within(child, seen))
        used = sorted({c for r in rows for c, lines in r.items() if lines})
        width = dict.fromkeys(used, 0)
        for r in rows:
            for c, lines in r.items():
                if lines:
                    width[c] = max(width[c], min(PAD, max(map(_wide, lines))))
        lines = list(before)
        for r in rows:
            cells = [r.get(c, []) for c in used]
            for k in range(max(map(len, cells), default=0)):
                parts_of_line = [c[k] if len(c) > k else "" for c in cells]
                lines.append(" | ".join(p + " " * (width[i] - _wide(p)) for i, p in zip(used, parts_of_line, strict=True)).rstrip())
        return lines


def visible_text(html: str | None) -> str:
    """All visible text of a page; empty for a null or empty page."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    return "\n".join(Layout(Styles(tree.root)).block(tree.root)).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of ``pages`` (page_id, html); whole pages, nothing shuffled.

    What style and hidden attributes, simple selectors of the page's own style sheets, and elements that are never
    rendered hide is left out; aria-hidden text is visible, and so is a visible part of a hidden one. A null or empty
    page has an empty text, and so has one with nothing visible; long and deeply nested pages are rendered whole.
    Repeated rows come back repeated, further columns are ignored, and an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                texts = pa.array([visible_text(h) for h in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")

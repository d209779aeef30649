"""Visible text of HTML pages, laid out as a browser would separate it.

A tree builder opens and closes elements with the implied tags of HTML (a new ``li`` ends the one
before, a block ends an open ``p``, a ``td`` lies in a row, content ends an open ``head``, an HTML
block ends an open drawing or formula, ...).  The renderer walks the tree and leaves out what is not
shown (scripts, styles, templates, the head, ``hidden`` attributes, ``display:none``, comments).
``visibility`` is inherited, and a child may reset it.  Blocks begin new lines, paragraphs and
headings keep a blank line apart, list items get bullets or numbers and are indented by depth, table
cells are padded to the width of their column, ``pre`` and ``textarea`` keep their white space.

A drop-down gives its chosen option (the last ``selected`` one, else the first that is not disabled),
a list box all its options and group labels on lines of their own.  Formulas give their text without
annotations, each ``text`` of a drawing is a line of its own; what a drawing only defines or
describes (``defs``, ``symbol``, ``title``, ``desc``, ...) is left out, ``use`` repeats no text.

A closed ``details`` shows its summary alone and a ``dialog`` only when it is open; buttons made by ``input`` show their
value.  Cells that span rows keep their column free in the rows below (``colspan`` counts up to ``MOST_SPAN``).  The
page's own style sheets are not read, so what only a class hides is shown.

No element is too deep and no text too long: both passes work with stacks of their own, in time that grows with the page.
The text stays in proportion too: a table whose aligned form would be more than ``MOST_PADDING`` times its cells' text
is given without padding and free columns, and lists are indented up to ``MOST_INDENTED`` levels.
A null page is empty and has an empty text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object canvas audio video datalist title".split())
# Content that may stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# Parts of drawings and formulas that are not shown where they stand.
UNDRAWN = {"svg": frozenset("title desc defs metadata symbol clippath mask marker pattern script style".split()),
           "math": frozenset(("annotation", "annotation-xml"))}
# Elements of drawings and formulas that hold HTML again, and HTML start tags that end a drawing or formula.
INSIDE = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
                     "pre ruby s small span strong strike sub sup table tt u ul var".split())
# Blocks, and those of them that keep a blank line around them.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr form fieldset".split())
BLOCK = APART | frozenset("html body div section article main header footer nav aside address li dt dd tr td th thead tbody tfoot "
                          "caption figcaption details summary center".split())
# start tag -> open elements it ends, looked for up to the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
    # A select is not closed by its end tag alone.
    "input": ({"select"}, BLOCK), "textarea": ({"select"}, BLOCK),
}
MOST_SPAN = 100
MOST_PADDING = 4
MOST_INDENTED = 16
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse|inherit|unset)\s*(!\s*important)?\s*(?=;|$)", re.I)
# Elements whose content is text without tags, where the parser does not know them by itself.
_RAW_TEXT = frozenset() if hasattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS") else frozenset(("textarea", "title"))
_SPACE = re.compile(r"[ \t\n\r\f]+")


class _Node:
    __slots__ = ("tag", "attrs", "children", "space")

    def __init__(self, tag, attrs=(), space=""):
        self.tag, self.attrs, self.children, self.space = tag, dict(attrs), [], space

    def inner_space(self):
        """The language of the children: HTML (""), svg or math."""
        return "" if self.space and self.tag in INSIDE[self.space] else self.space


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of the open elements by tag, in ascending order
        self.begun = False  # the head or the body was opened, so that no further head is

    def _push(self, node):
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, at):
        """Close the open elements from place ``at`` on."""
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def _last(self, tags):
        """The place of the lowest open element of ``tags``; 0 (the root) for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _end(self, names, fence):
        """Close the lowest run of open elements down to the outermost of ``names`` below ``fence``; of a single name the lowest one."""
        border = self._last(fence)
        found = []
        for name in names:
            at = self.places.get(name) or [0]
            place = at[-1] if len(names) == 1 else at[min(bisect_right(at, border), len(at) - 1)]
            if place > border:
                found.append(place)
        if found:
            self._cut(min(found))
        return bool(found)

    def _leave_head(self):
        if self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if self.open[-1].space and (tag in BREAKOUT or tag == "font" and not {"color", "face", "size"}.isdisjoint(dict(attrs))):
            while self.open[-1].inner_space():
                self._cut(len(self.open) - 1)
        space = tag if tag in ("svg", "math") else self.open[-1].inner_space()
        if space:
            self._leave_head()
            self.open[-1].children.append(node := _Node(tag, attrs, space))
            self._push(node)
            return
        if tag == "head":
            if self.begun:
                return
        elif tag not in HEAD:
            self._leave_head()
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "select" and self._end({"select"}, BLOCK):
            return
        self.begun = self.begun or tag not in HEAD and tag != "html"
        if tag in BLOCK:
            self._end({"p"}, {"td", "th", "li", "table", "button"})
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.handle_starttag("tr", [])
        node = _Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)
        if tag in _RAW_TEXT:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and (tag not in VOID or self.open[-1].space) and not self.cdata_elem:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self._leave_head()
            self.open[-1].children.append(_Node("br"))
            return
        at = self._last([tag])
        # An end tag does not reach out of its table.
        if at and (at >= self._last(["table"]) or tag in ("html", "body")):
            self._cut(at)

    def close(self):
        super().close()
        if self.cdata_elem == "textarea":  # not closed: it holds the rest of the page
            self.handle_data(self.rawdata)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and _SPACE.sub("", data):
            self._leave_head()
        if self.open[-1].tag == "textarea":
            data = unescape(data) if self.cdata_elem and _RAW_TEXT else data
            if not self.open[-1].children:
                data = data.removeprefix("\r").removeprefix("\n")
        self.open[-1].children.append(data)


class _Box:
    """Lines under construction."""

    def __init__(self):
        self.lines, self.line, self.gap = [], [], False

    def text(self, data, pre):
        if pre:
            for k, piece in enumerate(data.replace("\r\n", "\n").split("\n")):
                if k:
                    self.lines.append("".join(self.line))
                    self.line = []
                if piece:
                    self._open()
                    self.line.append(piece)
            return
        data = _SPACE.sub(" ", data)
        if data[:1] == " " and (not self.line or self.line[-1].endswith(" ")):
            data = data[1:]
        if data:
            self._open()
            self.line.append(data)

    def _open(self):
        if self.gap and not self.line:
            if self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False

    def end(self, apart=False):
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.gap = self.gap or apart

    def put(self, lines):
        if lines:
            self.end()
            self._open()
            self.lines.extend(lines)

    def done(self):
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(node, name: str) -> int:
    found = node.attrs.get(name) or "1"
    return min(int(found), MOST_SPAN) if found.isascii() and found.isdigit() and len(found) < 7 and int(found) else 1


def _placed(rows):
    """Rows of (lines, span): with an empty cell for every column that a cell above still spans."""
    held: dict[int, int] = {}  # column -> rows that are still spanned
    out = []
    for row in rows:
        new, at, fresh = [], 0, {}
        for lines, span, deep in row:
            while held.get(at):
                new.append(([], 1))
                at += 1
            new.append((lines, span))
            if deep > 1:
                fresh |= {at + k: deep - 1 for k in range(span)}
            at += span
        new += [([], 1)] * sum(1 for c in held if c >= at)
        held = {c: n - 1 for c, n in held.items() if n > 1} | fresh
        out.append(new)
    return out


def _aligned(rows) -> list[str]:
    """Lines of rows of cells (lines, column span, row span), every column padded to its widest cell."""
    text = sum(max(map(len, lines), default=0) * len(lines) + 3 for row in rows for lines, _, _ in row)
    flat = [[(lines, span) for lines, span, _ in row] for row in rows]
    extra = sum(span * (min(deep, len(rows) - k) - 1) for k, row in enumerate(rows) for _, span, deep in row)
    if extra and 3 * extra <= MOST_PADDING * text:
        flat = _placed(rows)
    width: list[int] = []
    for row in flat:
        at = 0
        for lines, span in row:
            width += [0] * (at + span - len(width))
            if span == 1:
                width[at] = max(width[at], max(map(len, lines), default=0))
            at += span
    before = [0]
    for w in width:
        before.append(before[-1] + w + 3)
    high = [max((len(lines) for lines, _ in row), default=0) for row in flat]
    # What the padded rows would take at most: each up to the start of its last cell.
    padded = sum(h * before[sum(span for _, span in row[:-1])] for h, row in zip(high, flat) if row)
    pad = padded <= MOST_PADDING * text
    out = []
    for h, row in zip(high, flat):
        for k in range(h):
            parts, at = [], 0
            for lines, span in row:
                room = before[at + span] - before[at] - 3 if pad else 0
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
                at += span
            out.append(" | ".join(parts).rstrip())
    return out


def _visible(node, inherited: bool) -> bool:
    """Whether ``node`` is visible, by the last of its weightiest declarations or else its parent."""
    found = _VISIBILITY.findall(node.attrs.get("style") or "")
    value = ([v for v, weight in found if weight] or [v for v, _ in found] or ["inherit"])[-1].lower()
    return value in ("visible", "initial") if value not in ("inherit", "unset") else inherited


def _undisplayed(node) -> bool:
    """Whether the last of the weightiest ``display`` declarations is ``none``."""
    found = _DISPLAY.findall(node.attrs.get("style") or "")
    return ([v for v, weight in found if weight] or [v for v, _ in found] or [""])[-1].lower() == "none"


def _hidden(node) -> bool:
    return "hidden" in node.attrs or _undisplayed(node) or node.tag == "dialog" and "open" not in node.attrs


def _shown_children(node) -> list:
    """The children that are shown: of a closed ``details`` its first summary alone."""
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1]
    return node.children


def _words(node) -> str:
    """The text of an option."""
    out, work = [], [node]
    while work:
        one = work.pop()
        if isinstance(one, str):
            out.append(one)
        elif one.tag not in UNSEEN:
            work.extend(reversed(one.children))
    return _SPACE.sub(" ", "".join(out)).strip(" ")


def _shown_options(select) -> tuple[list[str], bool]:
    """The labels a select shows, and whether it is a list box."""
    size = (select.attrs.get("size") or "").strip()
    boxed = "multiple" in select.attrs if not (size.isascii() and size.isdigit() and int(size)) else int(size) > 1
    rows, chosen, first = [], None, None
    work = [(child, False, False) for child in reversed(select.children)]
    while work:
        node, off, hidden = work.pop()
        if isinstance(node, str) or node.tag in UNSEEN:
            continue
        hidden = hidden or _hidden(node)
        if node.tag == "option":
            label = node.attrs.get("label") or _words(node)
            if not hidden:
                rows.append(label)
            if "selected" in node.attrs:
                chosen = label
            elif first is None and not off and "disabled" not in node.attrs:
                first = label
            continue
        if node.tag == "optgroup":
            off = "disabled" in node.attrs
            if not hidden:
                rows.append(node.attrs.get("label") or "")
        work.extend((child, off, hidden) for child in reversed(node.children))
    if not boxed:
        rows = [chosen if chosen is not None else first or ""]
    return [row for row in rows if row], boxed


def visible_text(html: str) -> str:
    """The visible text of one page."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    boxes, tables, lists = [_Box()], [], []
    work = [(builder.root, True)]
    pre = 0
    seen, drawn = [True], [True]  # of the open elements: visibility, and whether text is drawn in them
    while work:
        node, enter = work.pop()
        box = boxes[-1]
        if isinstance(node, str):
            if seen[-1] and drawn[-1]:
                box.text(node, pre > 0)
            continue
        tag = node.tag
        if node.space:
            if not enter:
                seen.pop()
                drawn.pop()
                if tag in ("text", "mtr"):
                    box.end()
                elif tag == "mtd":
                    box.text(" ", False)
            elif tag not in UNDRAWN[node.space] and not _undisplayed(node) and node.attrs.get("display") != "none":
                if tag in ("text", "mtr"):
                    box.end()
                if "visibility" in node.attrs and "visibility" not in (node.attrs.get("style") or "").lower():
                    node.attrs["style"] = f"visibility:{node.attrs['visibility']}"
                seen.append(_visible(node, seen[-1]) and tag != "mphantom")
                drawn.append(drawn[-1] and tag != "svg" or tag in ("text", "foreignobject"))
                work.append((node, False))
                work.extend((child, True) for child in reversed(node.children))
            continue
        if enter:
            if tag in UNSEEN or _hidden(node):
                continue
            if tag == "select":
                if _visible(node, seen[-1]) and drawn[-1]:
                    labels, boxed = _shown_options(node)
                    for label in labels:
                        if boxed:
                            box.end()
                        box.text(f" {label} ", False)
                    if boxed:
                        box.end()
                continue
            if tag == "input":
                if (node.attrs.get("type") or "").lower() in ("submit", "button", "reset") and _visible(node, seen[-1]) and drawn[-1]:
                    box.text(f" {node.attrs.get('value') or ''} ", False)
                continue
            if tag == "br" and not seen[-1]:
                box.end()
                continue
            if tag == "br":
                box.lines.append("".join(box.line).rstrip(" "))
                box.line = []
                continue
            if tag in BLOCK:
                box.end(tag in APART and not lists)
            seen.append(_visible(node, seen[-1]))
            drawn.append(drawn[-1])
            if tag == "textarea" and seen[-1]:
                box.text(" ", False)
            pre += tag in ("pre", "textarea")
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th", "li"):
                boxes.append(_Box())
            elif tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start") or "1"
                lists.append([tag, int(start) if start.isascii() and start.isdigit() else 1])
            work.append((node, False))
            work.extend((child, True) for child in reversed(_shown_children(node)))
            continue
        pre -= tag in ("pre", "textarea")
        shown = seen.pop()
        drawn.pop()
        if tag == "textarea" and shown:
            box.text(" ", False)
        if tag in ("td", "th"):
            lines = boxes.pop().done()
            if tables and tables[-1]:
                tables[-1][-1].append((lines, _number(node, "colspan"), _number(node, "rowspan")))
            else:
                boxes[-1].put(lines)
        elif tag == "li":
            lines = boxes.pop().done()
            kind = lists[-1] if lists else ["ul", 1]
            mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            mark = mark if shown else " " * len(mark)
            kind[1] += 1
            if len(lists) > MOST_INDENTED:
                boxes[-1].put([mark + lines[0], *lines[1:]] if lines else [])
            else:
                boxes[-1].put([(mark if not k else " " * len(mark)) + line if line else line for k, line in enumerate(lines)])
        elif tag == "table":
            boxes[-1].put(_aligned(tables.pop()))
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        if tag in BLOCK and tag not in ("td", "th", "li"):
            boxes[-1].end(tag in APART and not lists)
    return "\n".join(boxes[0].done())


def _texts(slices):
    for rows in slices:
        texts = [visible_text(h).strip("\n") for h in rows.column("html").to_pylist()]
        yield {"page_id": rows.column("page_id"), "text": texts, "n_chars": [len(t) for t in texts],
               "text_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]}


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, text, n_chars, text_sha256."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), text_or_empty("html").alias("html"))
    return map_rows(source, _texts, "page_id long, text string, n_chars long, text_sha256 string")

"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that supplies implied start and end tags; its
events, in document order and properly nested, drive a renderer that emits all
visible text with block spacing, list markers and aligned table cells.  Both work
without recursion and without looking through the open elements, so time grows
with the page's length alone.  Limits of layout, none of which loses text: tables nested
deeper than NESTED and tables of more than WIDEST columns are written without
alignment; an indent shows DEEPEST levels.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())
#: Parts of a drawing without text of their own, and elements that show text in one.
SVG_UNSEEN, SVG_TEXT = frozenset("defs desc metadata symbol clippath mask marker pattern".split()), frozenset({"text", "foreignobject"})
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCK = MARGIN | frozenset(
    "html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav option section summary tr caption thead tbody tfoot optgroup".split()
)
ENDS_P = BLOCK - frozenset("html body option optgroup tr caption thead tbody tfoot summary legend".split()) | {"summary"}
#: An open element of the left closes when one of the right starts, unless a boundary lies between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **{k: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for k in ("thead", "tbody", "tfoot")},
}
SCOPE = frozenset("table td th caption html template button object".split())
#: Quotes count after "=" only; what is open at the end of the page ends there.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_SHOWING = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)([^;]*)", re.I)
_CSS = re.compile(r"\"[^\"]*\"|'[^']*'|[{};]")
_LIMIT = re.compile(r"\(\s*(min|max)-(?:device-)?(width|height)\s*:\s*(\d*\.?\d+)\s*(px|r?em|)\s*\)")
#: The screen that pages are shown on, in pixels; a font's em is 16 of them.
SCREEN = {"width": 1280, "height": 800}
CELL_PAD, WIDEST, NESTED, DEEPEST = 40, 256, 8, 40


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


_CELL, _ROWS = frozenset({"td", "th"}), frozenset({"table", "thead", "tbody", "tfoot"})
_OF_TABLE = _CELL | _ROWS | {"tr"}


class _Open:
    """The open elements, with the depths of each tag's and of those that bound a paragraph."""

    def __init__(self):
        self.stack: list[str] = []
        self.where: dict[str, list[int]] = {}
        self.bounds: list[int] = []  # depths of SCOPE and BLOCK elements but p

    def push(self, tag: str) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag != "p" and (tag in SCOPE or tag in BLOCK):
            self.bounds.append(len(self.stack))
        self.stack.append(tag)

    def pop(self) -> str:
        tag = self.stack.pop()
        self.where[tag].pop()
        if self.bounds and self.bounds[-1] == len(self.stack):
            self.bounds.pop()
        return tag

    def top(self, *tags: str) -> int:
        """Depth of the innermost open one of tags, or -1."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def outermost(self, tags: frozenset[str] | set[str], above: int) -> int | None:
        """Depth of the outermost open one of tags that is deeper than ``above``."""
        found = []
        for t in tags:
            own = self.where.get(t, ())
            i = bisect(own, above)
            if i < len(own):
                found.append(own[i])
        return min(found, default=None)

    def last(self) -> str:
        return self.stack[-1] if self.stack else ""


def tree_events(page: str) -> Iterator[tuple[str, str, dict | str]]:
    """("start", tag, attributes), ("text", "", text), ("end", tag, {}) of the page's
    tree: every start has its end, in nesting order."""
    now = _Open()
    at = 0

    def close_to(depth: int):
        while len(now.stack) > depth:
            yield "end", now.pop(), {}

    def start(tag: str):
        now.push(tag)
        yield "start", tag, {}

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            if now.last() == "head" and text.strip(" \t\n\r\f"):
                yield from close_to(len(now.stack) - 1)
            if (now.last() in _ROWS or now.last() == "tr") and text.strip():
                # stray text in a table belongs to a cell of its own
                if now.last() != "tr":
                    yield from start("tr")
                yield from start("td")
            yield "text", "", html.unescape(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = now.top(tag)
            if depth >= 0:
                inner = max(now.bounds[-1] if now.bounds else -1, now.top("p"))
                free = tag in BLOCK or tag in _OF_TABLE or inner <= depth
                if free and (tag in _OF_TABLE or tag in ("html", "body") or now.top("td", "th", "table") <= depth):
                    yield from close_to(depth)
            elif tag == "br":
                if now.last() == "head":
                    yield from close_to(len(now.stack) - 1)
                yield "start", "br", {}
                yield "end", "br", {}
            continue
        attrs = _attrs(m[3])
        if tag in IMPLIED_END:
            closes, stops = IMPLIED_END[tag]
            depth = now.outermost(closes, now.top(*(stops - closes)))
            if depth is not None:
                yield from close_to(depth)
            if tag in _CELL and now.last() in _ROWS:
                yield from start("tr")
        if tag in ENDS_P and now.top("p") > (now.bounds[-1] if now.bounds else -1):
            yield from close_to(now.top("p"))
        if tag in ("html", "body") and now.where.get(tag):
            continue
        if now.last() == "head" and tag not in HEAD:
            yield from close_to(len(now.stack) - 1)
        if now.where.get("head") and (tag == "body" or (tag in BLOCK and not now.where.get("template"))):
            yield from close_to(now.where["head"][0])
        yield "start", tag, attrs
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            yield "end", tag, {}
            continue
        if tag in RAW and m[4]:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            body = page[at:stop]
            if body:
                yield "text", "", html.unescape(body) if tag in ("textarea", "title") else body
            gt = page.find(">", stop) if end else -1
            at = gt + 1 if gt >= 0 else len(page)
            yield "end", tag, {}
            continue
        now.push(tag)
    yield from close_to(0)


def on_screen(query: str) -> bool:
    """Whether one of a list of media queries surely holds for SCREEN: an unknown condition doesn't."""

    def holds(one: str) -> bool:
        m = re.fullmatch(r"(?:(not|only)\s+)?([a-z-]+)?((?:\s*(?:and\b)?\s*\([^()]*\))*)", one)
        if not m or m[1] == "not" and m[3]:
            return False
        if (m[2] in (None, "all", "screen")) == (m[1] == "not"):
            return False
        for part in re.findall(r"\([^()]*\)", m[3]):
            x = _LIMIT.fullmatch(part)
            if x:
                size = float(x[3]) * (16 if x[4].endswith("em") else 1)
                if SCREEN[x[2]] < size if x[1] == "min" else SCREEN[x[2]] > size:
                    return False
            elif not re.fullmatch(r"\(\s*orientation\s*:\s*landscape\s*\)", part):
                return False
        return True

    return not query.strip() or any(holds(q.strip()) for q in query.lower().split(","))


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet's rules that hold on the screen, in order."""
    open_blocks: list[list] = []  # selectors or None, whether it holds, declarations
    start = 0
    for m in _CSS.finditer(sheet + "}" * (sheet.count("{") + 1)):
        what = m[0]
        if what[0] in "\"'":
            continue
        text, start = sheet[start : m.start()].strip(), m.end()
        top = open_blocks[-1] if open_blocks else None
        if what == "{":
            holds = top is None or top[1]
            if text.startswith("@"):
                name, _, rest = text[1:].partition(" ") if "(" not in text.split(" ")[0] else (text[1 : text.index("(")], "", text[text.index("(") :])
                name = name.lower()
                open_blocks.append([None, holds and (top is None or top[0] is None) and (name == "layer" or name == "media" and on_screen(rest)), []])
            else:
                open_blocks.append([text, holds and (top is None or top[0] is None), []])
        else:
            if top is not None:
                top[2].append(text)
            if what == "}" and top is not None:
                open_blocks.pop()
                if top[0] is not None and top[1]:
                    yield top[0], ";".join(top[2])


def _verdicts(declarations: str) -> dict[str, tuple[bool, bool]]:
    """For display and visibility whether the winning declaration is important, and whether it hides."""
    out: dict[str, tuple[bool, bool]] = {}
    for prop, value, more in _SHOWING.findall(declarations):
        important = "important" in more.lower()
        if important or not out.get(prop.lower(), (False, False))[0]:
            out[prop.lower()] = important, value.lower() in ("none", "hidden", "collapse")
    return out


_COMPOUND = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+)*)")


def style_index(page: str) -> dict[str, list[tuple[frozenset[str], dict[str, tuple]]]]:
    """The rules of the page's style sheets on display and visibility, if any of them hides:
    by one part of the selector, (all parts, the (important, specificity, order, hides) that win).

    Selectors are a tag, classes and ids, alone or joined (div.k#x); a rule with
    combinators, pseudo-classes or attributes is left out: its text stays."""
    won: dict[frozenset[str], dict[str, tuple]] = {}
    order = 0
    for attrs, sheet in re.findall(r"<style([^>]*)>(.*?)(?:</style|\Z)", page, re.S | re.I):
        if not on_screen(_attrs(attrs).get("media", "")):
            continue
        for selectors, body in style_rules(re.sub(r"<!--|-->|/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)):
            order += 1
            for prop, (important, hides) in _verdicts(body).items():
                for name in selectors.split(","):
                    m = _COMPOUND.fullmatch(name.strip().lower())
                    if not m or not m[0]:
                        continue
                    parts = frozenset([*re.findall(r"[.#][\w-]+", m[2]), *([m[1]] if m[1] and (m[1] != "*" or not m[2]) else [])])
                    rank = m[2].count("#"), m[2].count("."), int(bool(m[1]) and m[1] != "*")
                    own = important, rank, order, hides
                    was = won.setdefault(parts, {})
                    was[prop] = max(was.get(prop, own), own)
    if not any(x[3] for rule in won.values() for x in rule.values()):
        return {}
    used: dict[str, int] = {}
    for parts in won:
        for x in parts:
            used[x] = used.get(x, 0) + 1
    index: dict[str, list] = {}
    for parts, rule in won.items():
        index.setdefault(min(parts, key=lambda x: (used[x], x)), []).append((parts, rule))
    return index


def _shown(tag: str, attrs: dict[str, str], rules: dict[str, list]) -> tuple[bool | None, bool | None]:
    """What styles say of an element: whether display and visibility hide it; None where they say nothing."""
    won: dict[str, tuple] = {}
    if rules:
        names = {"*", tag, *(f".{c.lower()}" for c in attrs.get("class", "").split())}
        if attrs.get("id"):
            names.add(f"#{attrs['id'].lower()}")
        for name in names:
            for parts, rule in rules.get(name, ()):
                if parts <= names:
                    for prop, own in rule.items():
                        won[prop] = max(won.get(prop, own), own)
    for prop, (important, hides) in _verdicts(attrs["style"]).items() if "style" in attrs else ():
        own = important, (1 << 30, 0, 0), 0, hides
        won[prop] = max(won.get(prop, own), own)
    return tuple(won[p][3] if p in won else None for p in ("display", "visibility"))


class _Flow:
    """Lines of one block context: the page or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line breaks due before the next text
        self.space = False
        self.marker = ""

    def break_line(self, blank: bool) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        if self.lines:
            self.gap = max(self.gap, 1 if blank else 0)

    def hard_break(self, indent: str) -> None:
        self._open(indent)
        self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def _open(self, indent: str) -> None:
        if not self.line:
            if self.gap and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            if self.marker:
                self.line.append(self.marker)
                self.marker = ""
            elif indent:
                self.line.append(indent)
            self.space = False

    def text(self, s: str, indent: str, pre: bool) -> None:
        if pre:
            rows = s.split("\n")
            for i, row in enumerate(rows):
                if row:
                    self._open(indent)
                    self.line.append(row)
                if i < len(rows) - 1:
                    if not self.line and not self.lines:
                        continue
                    self.lines.append("".join(self.line).rstrip())
                    self.line = []
            return
        words = _SPACE.sub(" ", s)
        if words == " ":
            self.space = bool(self.line)
            return
        lead = words[0] == " "
        fresh = not self.line
        self._open(indent)
        if (lead or self.space) and not fresh:
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def finish(self) -> str:
        self.break_line(False)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines).replace("\u00a0", " ")


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells (text, colspan, rowspan) as lines with aligned columns.  Columns in which no cell begins aren't shown."""
    placed: list[list[tuple[int, list[str]]]] = []
    busy: list[tuple[int, int, int]] = []  # columns begin:end taken until a row
    for y, row in enumerate(rows):
        busy = [b for b in busy if b[2] > y]
        x, i, own, added = 0, 0, [], []
        for text, cols, down in row:
            while i < len(busy) and busy[i][0] <= x:
                x = max(x, busy[i][1])
                i += 1
            own.append((x, text.split("\n") if text else [""]))
            if down > 1:
                if added and added[-1][1:] == (x, y + down):
                    added[-1] = (added[-1][0], x + cols, y + down)
                else:
                    added.append((x, x + cols, y + down))
            x += cols
        placed.append(own)
        if added:
            busy = sorted(busy + added)
    number = {x: i for i, x in enumerate(sorted({x for own in placed for x, _ in own}))}
    aligned = len(number) <= WIDEST
    width: dict[int, int] = {}
    for own in placed if aligned else ():
        for x, ls in own:
            width[number[x]] = max(width.get(number[x], 0), *map(len, ls))
    out = []
    for own in placed:
        if not any(any(ls) for _, ls in own):
            continue
        cells = {number[x] if aligned else i: ls for i, (x, ls) in enumerate(own)}
        columns = range(max(cells) + 1)
        for i in range(max(map(len, cells.values()))):
            line = [cells[x][i] if x in cells and i < len(cells[x]) else "" for x in columns]
            while len(line) > 1 and not line[-1]:
                line.pop()
            out.append(" | ".join(c.ljust(min(width.get(x, 0), CELL_PAD)) for x, c in enumerate(line)).rstrip())
    return out


def page_text(page: str) -> str:
    """All visible text of a page in its layout."""
    rules = style_index(page)
    flow, flows = _Flow(), []
    hidden, unseen = 0, False  # open elements that aren't displayed; inherited visibility
    path: list[tuple[str, bool, bool]] = []  # tag, whether it isn't displayed, visibility around it
    drawn: list[str] = []  # open svg elements and, in them, elements that show text
    math = 0
    lists: list[list] = []  # kind, counter
    margin: list[str] = []  # indents of open lists, quotes and definitions
    pre = flat = 0
    tables: list[list[list[tuple[str, int, int]]]] = []
    spans: list[tuple[int, int]] = []

    def number(x: str, most: int) -> int:
        return min(max(int(x), 1), most) if re.fullmatch(r"[0-9]{1,9}", x) else 1

    def indent(upto: int | None = None) -> str:
        return "".join(margin[: DEEPEST if upto is None else min(upto, DEEPEST)])

    for kind, tag, what in tree_events(page):
        if kind == "text":
            if not hidden and not unseen and what and (not drawn or drawn[-1] != "svg"):
                flow.text(what, indent(), pre > 0)
        elif kind == "start":
            gone, invisible = _shown(tag, what, rules)
            gone = tag in UNSEEN or (tag == "input" and what.get("type", "").lower() == "hidden") or ("hidden" in what if gone is None else gone)
            gone = gone or (bool(drawn) and tag in SVG_UNSEEN) or (math > 0 and tag in ("annotation", "annotation-xml"))
            math += tag == "math"
            if tag == "svg" or drawn and tag in SVG_TEXT:
                drawn.append(tag)
                if not hidden and not gone and tag != "svg":
                    flow.text(" ", indent(), False)
            path.append((tag, gone, unseen))
            hidden += gone
            unseen = unseen if invisible is None else invisible
            if hidden:
                continue
            if tag == "br":
                flow.hard_break(indent())
            elif tag == "table" and (flat or len(tables) >= NESTED):
                flat += 1
                flow.break_line(True)
            elif flat and tag in _CELL:
                flow.text(" ", indent(), False)
            elif tag == "table":
                flow.break_line(True)
                tables.append([])
            elif tag == "tr" and tables and not flat:
                tables[-1].append([])
            elif tag in _CELL and tables:
                if not tables[-1]:
                    tables[-1].append([])
                spans.append((number(what.get("colspan", ""), 1000), number(what.get("rowspan", ""), 65534)))
                flows.append((flow, lists, margin))
                flow, lists, margin = _Flow(), [], []
            elif tag in BLOCK:
                flow.break_line(tag in MARGIN and not (tag in ("ul", "ol") and lists))
                if tag in ("ul", "ol", "menu", "dir"):
                    first = what.get("start", "")
                    lists.append(["ol" if tag == "ol" else "ul", int(first) - 1 if re.fullmatch(r"-?[0-9]{1,9}", first) else 0])
                    margin.append("  ")
                elif tag == "li":
                    if lists:
                        lists[-1][1] += 1
                    mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                    flow.marker = indent(max(len(margin) - 1, 0)) + mark
                elif tag in ("blockquote", "dd"):
                    margin.append("> " if tag == "blockquote" else "  ")
                elif tag == "pre":
                    pre += 1
            elif tag == "input" and not unseen and what.get("value") and what.get("type", "text").lower() in ("text", "submit", "button", "search", "reset"):
                flow.text(what["value"], indent(), False)
        else:
            while path:
                own, gone, unseen = path.pop()
                seen = not hidden
                hidden -= gone
                math -= own == "math"
                if drawn and own == drawn[-1]:
                    drawn.pop()
                    if seen and own != "svg":
                        flow.text(" ", indent(), False)
                if own == tag:
                    break
            if not seen:
                continue
            if flat and tag in _OF_TABLE:
                if tag in ("table", "tr"):
                    flat -= tag == "table"
                    flow.break_line(tag == "table")
            elif tag in _CELL and tables and flows:
                text = flow.finish()
                flow, lists, margin = flows.pop()
                tables[-1][-1].append((text, *spans.pop()))
            elif tag == "table" and tables:
                for line in _table(tables.pop()):
                    flow.text(line, indent(), True)
                    flow.break_line(False)
                flow.break_line(True)
            elif tag in BLOCK and tag != "tr":
                flow.break_line(tag in MARGIN and not (tag in ("ul", "ol") and len(lists) > 1))
                if tag in ("ul", "ol", "menu", "dir") and lists:
                    lists.pop()
                    margin.pop()
                elif tag == "li":
                    flow.marker = ""
                elif tag in ("blockquote", "dd"):
                    margin.pop()
                elif tag == "pre":
                    pre = max(pre - 1, 0)
    return flow.finish()


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page.

    Null or empty html: an empty text.  Null and repeated ids pass through; other
    columns are ignored; an empty table gives none.  Text that no tag encloses,
    unclosed tags and unclosed comments are handled as a browser shows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        for b in batches:
            lo, texts, size = 0, [], 0
            for i, page in enumerate(b.column(2)):
                texts.append(page_text(page.as_py() or ""))
                size += len(texts[-1])
                if size > 4 << 20 or i == b.num_rows - 1:
                    yield out(b.slice(lo, len(texts)), texts)
                    lo, texts, size = i + 1, [], 0

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")

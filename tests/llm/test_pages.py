"""Random trees rendered by a plain recursive version, and pages that are hard on a renderer."""

import random
import time
import tracemalloc

import pytest
from stratalens.llm import pages

INLINE, PLAIN = ("b", "i", "span", "a"), ("div", "section", "p", "h2")
STYLE = "<style>.k{display:none}.v{visibility:hidden}b.k#q{display:inline}i.w,.w.z{display:none}.s{visibility:visible}@media print{div{display:none}}</style>"


def tree(rng, depth, where="flow"):
    """(tag, attributes, children); a child may be a word."""
    attrs = rng.choice([{}] * 6 + [{"class": "k"}, {"class": "v"}, {"class": "s"}, {"class": "w"}, {"class": "w z"}, {"class": "k", "id": "q"}, {"style": "display:none"}, {"style": "visibility:visible"}])
    if where == "inline" or depth == 0:
        return rng.choice(INLINE), attrs, [f"w{rng.randrange(100)}" for _ in range(rng.randrange(1, 3))]
    tag = rng.choice([*INLINE, *PLAIN, "ul", "ol", "table", "blockquote"])
    if tag in ("ul", "ol"):
        return tag, attrs, [("li", {}, kids(rng, depth - 1, "flow")) for _ in range(rng.randrange(1, 4))]
    if tag == "table":
        return tag, attrs, [("tr", {}, [("td", {}, kids(rng, 0, "inline")) for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(1, 4))]
    return tag, attrs, kids(rng, depth - 1, "inline" if tag in (*INLINE, "p", "h2") else "flow")


def kids(rng, depth, where):
    return [f"w{rng.randrange(100)}" if rng.random() < 0.4 else tree(rng, depth, where) for _ in range(rng.randrange(1, 4))]


def source(node):
    if isinstance(node, str):
        return f"{node} "
    tag, attrs, children = node
    inside = "".join(map(source, children))
    return f"<{tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attrs.items())}>{inside}</{tag}>"


def state(tag, attrs, seen):
    """(displayed, visible) by the rules of STYLE, written out."""
    classes = set(attrs.get("class", "").split())
    shown = not ("k" in classes and not (tag == "b" and attrs.get("id") == "q"))
    shown &= not ("w" in classes and (tag == "i" or "z" in classes))
    if "style" in attrs and "display" in attrs["style"]:
        shown = False
    if "v" in classes:
        seen = False
    if "s" in classes or "visibility" in attrs.get("style", ""):
        seen = True
    return shown, seen


def plain(node, seen=True):
    """Lines of words of a node, None for a break."""
    if isinstance(node, str):
        return [node] if seen else []
    tag, attrs, children = node
    shown, seen = state(tag, attrs, seen)
    if not shown:
        return []
    if tag in ("ul", "ol"):
        out = []
        for i, (_, _, inner) in enumerate(children, 1):
            own = [x for c in inner for x in plain(c, seen)]
            at = next((j for j, x in enumerate(own) if x is not None), None)
            if at is not None and not any(x is None for x in own[:at]):
                own.insert(at, "-" if tag == "ul" else f"{i}.")
            elif at is not None:
                own.insert(at, "-" if tag == "ul" else f"{i}.") if own[at] not in ("-", "|") else None
            out += [None, *own, None]
        return [None, *out, None]
    if tag == "table":
        out = []
        for _, _, cells in children:
            row = []
            for _, _, inner in cells:
                row.append([x for c in inner for x in plain(c, seen)])
            while row and not row[-1]:
                row.pop()
            line = []
            for i, cell in enumerate(row):
                line += (["|"] if i else []) + cell
            out += [None, *line, None]
        return [None, *out, None]
    own = [x for c in children for x in plain(c, seen)]
    return [None, *own, None] if tag in (*PLAIN, "blockquote") else own


def lines(marks):
    out = [[]]
    for x in marks:
        if x is None:
            out.append([])
        else:
            out[-1].append(x)
    return [x for x in out if x]


def words(text):
    """Words of each line, quote marks left out."""
    return [x for x in ([w for w in line.split() if w != ">"] for line in text.split("\n")) if x]


@pytest.mark.parametrize("seed", range(150))
def test_random_trees(seed):
    rng = random.Random(seed)
    body = kids(rng, 3, "flow")
    page = STYLE + "".join(map(source, body))
    want = lines([x for c in body for x in plain(c)])
    got = words(pages.page_text(page))
    # which line a list mark leads is tested elsewhere where a list begins in an item's first line
    mark = lambda rows: [[w for w in r if w != "-" and not w[:-1].isdigit()] for r in rows]
    assert [r for r in mark(got) if r] == [r for r in mark(want) if r], page
    assert sum(w == "|" for r in got for w in r) == sum(w == "|" for r in want for w in r)


@pytest.mark.parametrize(
    "page, length",
    [
        ("<table><tr>" + "<td colspan=1000 rowspan=1000>a" * 5, 17),
        ("<div>" * 20000 + "<li>a" * 20000, 79999),
        ("<i>" * 20000 + "<p>a</p>" * 20000, 59998),
        ("<table><tr><td>a" * 10000, 19999),
        ("<a " * 20000 + "'", 0),
        ("<blockquote>a" * 15000, None),
        ("<table><tr>" + "<td rowspan=1000>a" * 8000 + "<tr><td>b" * 1000, 33997),
        ("<style>" + "".join(f".k.x{i}{{display:none}}" for i in range(5000)) + "</style>" + "<i class=k>a</i>" * 5000, 5000),
    ],
)
def test_hostile_pages(page, length):
    began = time.time()
    text = pages.page_text(page)
    assert time.time() - began < 10  # about a second on a free machine
    assert length is None or len(text) == length
    tracemalloc.start()
    pages.page_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


@pytest.mark.parametrize(
    "page, want",
    [
        ("<style>div.k{display:none}</style><div class=k>hid</div><i class=k>seen</i>", "seen"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
        ("<div hidden style='display:block'>x</div>", "x"),
        ("<p it's>a<p>it's<a href='x", "a\n\nit's"),
        ("a</ >b</>c", "abc"),
        ("<blockquote>q<ul><li>x</ul></blockquote>", "> q\n\n> - x"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ],
)
def test_shown_and_placed(page, want):
    assert pages.page_text(page) == want

"""Go symbols: top-level functions, methods and types."""

from __future__ import annotations

from .lexer import Source, symbol


def _end_of_function(src: Source, i: int) -> int:
    """Last token of a function whose parameters end at token i."""
    j = i + 1
    while j < len(src.tokens):
        if src.new_line(j):
            return j - 1
        if src.is_(j, "interface", "struct") and src.is_(j + 1, "{"):
            j = src.match[j + 1] + 1
            continue
        if src.is_(j, "{"):
            return src.match[j]
        j = src.match[j] + 1 if src.is_(j, "(", "[") else j + 1
    return len(src.tokens) - 1


def _receiver(src: Source, i: int) -> str | None:
    """Type name in a receiver list that opens at token i; pointers and type arguments unwrapped."""
    inside = [j for j in range(i + 1, src.match[i]) if src.word(j)]
    named = [j for j in inside if not src.is_(j - 1, "[", ",")]
    return src.tokens[named[-1]].text if named else None


def _doc(src: Source, i: int, after: int) -> str | None:
    lines = [c.text.strip() for c in src.comments_before(i, after)]
    kept = [x.lstrip("/ ").lstrip("* ").strip() for x in lines if not x.startswith("//go:")]
    return " ".join(kept) if kept else None


def _specs(src: Source, i: int) -> tuple[list[int], int]:
    """Name tokens of the specs of a type declaration at token i, and its last token."""
    names, j = [], i + 1
    grouped = src.is_(j, "(")
    stop = src.match[j] if grouped else len(src.tokens)
    j += grouped
    last = j
    while j < stop:
        names.append(j)
        while True:
            j = src.match[j] + 1 if src.is_(j, "(", "[", "{") else j + 1
            if j >= stop or src.is_(j, ";") or src.new_line(j) and not src.is_(j - 1, "=", "|", ",", "."):
                break
        last = j - 1
        j += src.is_(j, ";")
        if not grouped:
            break
    return names, stop if grouped else last


def extract(text: str, module: str) -> list[dict]:
    src, out = Source(text, "go"), []
    package, i, after = module.split(".")[-1], 0, 0
    while i < len(src.tokens):
        if src.is_(i, "package") and src.word(i + 1):
            package, last = src.tokens[i + 1].text, i + 1
        elif src.is_(i, "func"):
            receiver, j = None, i + 1
            if src.is_(j, "("):
                receiver, j = j, src.match[j] + 1
            name, k = src.tokens[j].text if src.word(j) else None, j + 1
            if src.is_(k, "["):
                k = src.match[k] + 1
            params = src.between(k, src.match[k]) if src.is_(k, "(") else "()"
            last = _end_of_function(src, src.match[k] if src.is_(k, "(") else j)
            start, end, doc = src.line(src.tokens[i].begin), src.line(src.tokens[last].begin), _doc(src, i, after)
            if name and receiver is None:
                out.append(symbol(name, f"{package}.{name}", "function", f"func {name}{params}", start, end, doc))
            elif name:
                own = _receiver(src, receiver)
                held = src.between(receiver, src.match[receiver])
                out.append(symbol(name, ".".join(x for x in (package, own, name) if x), "method", f"func {held} {name}{params}", start, end, doc))
        elif src.is_(i, "type"):
            names, last = _specs(src, i)
            start, end, doc = src.line(src.tokens[i].begin), src.line(src.tokens[last].begin), _doc(src, i, after)
            for n in names:
                if not src.word(n):
                    continue
                j = n + 1
                if src.is_(j, "[") and src.match[j] > j + 1 and not src.is_(src.match[j] + 1, "=") and src.word(j + 1) and not src.is_(j + 2, "]"):
                    j = src.match[j] + 1
                if src.is_(j, "="):  # an alias is no type of its own
                    continue
                name, kind = src.tokens[n].text, "interface" if src.is_(j, "interface") else "struct"
                out.append(symbol(name, f"{package}.{name}", kind, f"type {name} {kind}", start, end, doc))
        else:  # var, const, import: to the end of the line or group
            last = i
            while last + 1 < len(src.tokens) and not src.new_line(last + 1):
                last = src.match[last + 1] if src.is_(last + 1, "(", "[", "{") else last + 1
            last = src.match[last] if src.is_(last, "(", "[", "{") else last
        after, i = src.tokens[last].end, last + 1
    return out


def imports(text: str, grouped: bool = False) -> list[str]:
    """Last path segments of single import declarations; of those in parentheses too if ``grouped``."""
    src, out = Source(text, "go"), []
    if grouped:
        for i, t in enumerate(src.tokens):
            if t.kind == "word" and t.text == "import" and src.is_(i + 1, "("):
                j = i + 2
                while j < len(src.tokens) and not src.is_(j, ")"):
                    if src.tokens[j].kind == "string":
                        path = src.tokens[j].text.strip('"`').rsplit("/", 1)[-1]
                        out += [path] if path else []
                    j += 1
    for i, t in enumerate(src.tokens):
        if t.kind == "word" and t.text == "import" and not src.is_(i + 1, "("):
            j = i + 1 + (src.word(i + 1) or src.is_(i + 1, ".", "_"))
            if j < len(src.tokens) and src.tokens[j].kind == "string":
                path = src.tokens[j].text.strip('"').rsplit("/", 1)[-1]
                out += [path] if path else []
    return out

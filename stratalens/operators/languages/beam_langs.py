"""Gleam and Erlang symbols."""

from __future__ import annotations

from .lexer import Source, symbol


def _line_doc(src: Source, i: int, after: int, mark: str, strip: str) -> str | None:
    """The comment line that comes last before token i, if it has the mark."""
    found = src.comments_before(i, after)
    if not found or not found[-1].text.startswith(mark):
        return None
    text = found[-1].text.lstrip(strip).strip()
    if text.startswith("@doc"):
        text = text[4:].strip()
    return text or None


def extract_gleam(text: str, module: str) -> list[dict]:
    src, out, i, after = Source(text, "gleam"), [], 0, 0
    while i < len(src.tokens):
        first = i
        while src.is_(i, "@"):  # attributes
            i += 2
            i = src.match[i] + 1 if src.is_(i, "(") else i
        pub = src.is_(i, "pub")
        i += pub
        i += src.is_(i, "opaque")
        lead, last = "pub " if pub else "", i
        doc = _line_doc(src, first, after, "///", "/ ")
        start = src.line(src.tokens[min(first, len(src.tokens) - 1)].begin)
        name = src.tokens[i + 1].text if src.word(i + 1) else None
        row = None
        if src.is_(i, "fn") and name and src.is_(i + 2, "("):
            close = src.match[i + 2]
            signature = f"{lead}fn {name}{src.between(i + 2, close)}"
            j = close + 1
            if src.is_(j, "->"):
                k = j + 1
                while k < len(src.tokens) and not src.is_(k, "{") and not src.new_line(k):
                    k = src.match[k] + 1 if src.is_(k, "(") else k + 1
                signature += f" -> {src.between(j + 1, k - 1)}"
                j = k
            last = src.match[j] if src.is_(j, "{") else j - 1
            row = (name, "function", signature)
        elif src.is_(i, "type") and name:
            j = i + 2
            j = src.match[j] + 1 if src.is_(j, "(") else j
            if src.is_(j, "="):
                last = j
                while last + 1 < len(src.tokens) and (not src.new_line(last + 1) or last == j):
                    last = src.match[last + 1] if src.is_(last + 1, "(") else last + 1
                row = (name, "type_alias", f"{lead}type {name}")
            else:
                last = src.match[j] if src.is_(j, "{") else j - 1
                row = (name, "enum", f"{lead}type {name}")
        elif src.is_(i, "const") and name:
            last = i
            while last + 1 < len(src.tokens) and not (src.new_line(last + 1) and not src.is_(last, "=")):
                last = src.match[last + 1] if src.is_(last + 1, "(", "[", "{") else last + 1
            row = (name, "constant", f"{lead}const {name}")
        else:  # an import, or something unknown: to the line's end
            while last + 1 < len(src.tokens) and not src.new_line(last + 1):
                last = src.match[last + 1] if src.is_(last + 1, "(", "[", "{") else last + 1
        last = min(max(last, first), len(src.tokens) - 1)
        if row:
            out.append(symbol(row[0], f"{module}.{row[0]}", row[1], row[2], start, src.line(src.tokens[last].begin), doc))
        after, i = src.tokens[last].end, last + 1
    return out


_BLOCKS = frozenset("case if receive begin try maybe".split())


def _clause_end(src: Source, i: int) -> int:
    """Last token (; or .) of the clause or form that starts at token i."""
    depth = 0
    while i < len(src.tokens):
        if src.is_(i, "(", "[", "{"):
            i = src.match[i] + 1
            continue
        if src.word(i) and src.tokens[i].text in _BLOCKS or src.is_(i, "fun") and src.is_(i + 1, "("):
            depth += 1
        elif src.is_(i, "end"):
            depth -= 1
        elif src.is_(i, ";") and depth <= 0:
            return i
        elif src.is_(i, ".") and depth <= 0 and (i + 1 == len(src.tokens) or src.text[src.tokens[i].end : src.tokens[i].end + 1].isspace() or src.text[src.tokens[i].end : src.tokens[i].end + 1] == "%"):
            return i
        i += 1
    return len(src.tokens) - 1


def extract_erlang(text: str, module: str) -> list[dict]:
    src, out, i, after, seen = Source(text, "erlang"), [], 0, 0, set()
    while i < len(src.tokens):
        last = _clause_end(src, i)
        doc = _line_doc(src, i, after, "%", "% ")
        lines = src.line(src.tokens[i].begin), src.line(src.tokens[last].begin)
        if src.is_(i, "-"):
            while src.is_(last, ";"):
                last = _clause_end(src, last + 1)
            lines = lines[0], src.line(src.tokens[last].begin)
            name_at = i + 2 + src.is_(i + 2, "(")
            name = src.tokens[name_at].text if name_at < len(src.tokens) else ""
            if src.is_(i + 1, "type", "opaque") and name and src.is_(i + 1, "type"):
                out.append(symbol(name, f"{module}.{name}", "type_alias", f"-type {name}()", *lines, doc))
            elif src.is_(i + 1, "record") and name:
                out.append(symbol(name, f"{module}.{name}", "record", f"-record({name}, ...)", *lines, doc))
        elif src.is_(i + 1, "(") and (src.word(i) or src.tokens[i].text.startswith("'")):
            name = src.tokens[i].text
            if name not in seen:
                seen.add(name)
                out.append(symbol(name, f"{module}.{name}", "function", f"{name}{src.between(i + 1, src.match[i + 1])}", *lines, doc))
        after, i = src.tokens[last].end, last + 1
    return out

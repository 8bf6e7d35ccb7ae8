"""Java symbols: types, their members and enum constants."""

from __future__ import annotations

from .lexer import Source, symbol

_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
_TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}


class _Reader:
    def __init__(self, text: str, module: str):
        self.src, self.out = Source(text, "java"), []
        self.package = module

    def qualify(self, types: tuple[str, ...], name: str) -> str:
        return ".".join([*([self.package] if self.package else []), *types, name])

    def modifiers(self, i: int) -> int:
        src = self.src
        while i < len(src.tokens):
            if src.is_(i, "@") and not src.is_(i + 1, "interface"):
                i += 2
                while src.is_(i, ".") and src.word(i + 1):
                    i += 2
                if src.is_(i, "("):
                    i = src.match[i] + 1
            elif src.is_(i, "non") and src.is_(i + 1, "-"):
                i += 3
            elif src.word(i) and src.tokens[i].text in _MODIFIERS:
                i += 1
            else:
                break
        return i

    def top(self) -> list[dict]:
        src, i, after = self.src, 0, 0
        while i < len(src.tokens):
            if src.is_(i, "package", "import"):
                j = i
                while j < len(src.tokens) and not src.is_(j, ";"):
                    j += 1
                if src.is_(i, "package"):
                    self.package = src.text[src.tokens[i + 1].begin : src.tokens[j - 1].end] if j > i + 1 else self.package
                i, after = j + 1, src.tokens[min(j, len(src.tokens) - 1)].end
                continue
            last = self.member(i, (), after)
            after, i = src.tokens[min(last, len(src.tokens) - 1)].end, last + 1
        return self.out

    def type_text(self, i: int) -> int:
        """Index after a type that starts at i."""
        src = self.src
        while src.word(i):
            i = src.skip_angles(i + 1)
            if not src.is_(i, "."):
                break
            i += 1
        while src.is_(i, "[") and src.is_(i + 1, "]"):
            i += 2
        return i

    def names(self, i: int) -> tuple[list[str], int]:
        """Comma-separated types from i."""
        found = []
        while True:
            j = self.type_text(self.modifiers(i))
            if j == i:
                return found, i
            found.append(self.src.between(self.modifiers(i), j - 1))
            if not self.src.is_(j, ","):
                return found, j
            i = j + 1

    def member(self, i: int, types: tuple[str, ...], after: int) -> int:
        """Reads the declaration at token i; returns its last token."""
        src, first = self.src, i
        i = self.modifiers(i)
        is_type = src.word(i) and src.tokens[i].text in _TYPES and src.word(i + 1) and not (src.tokens[i].text == "record" and not src.is_(src.skip_angles(i + 2), "("))
        if is_type:
            return self.type_(first, i, types, after)
        if src.is_(i, "@") and src.is_(i + 1, "interface"):
            j = i
            while j < len(src.tokens) and not src.is_(j, "{"):
                j += 1
            return src.match.get(j, len(src.tokens) - 1)
        if src.is_(i, "{"):
            return src.match[i]
        if src.is_(i, ";"):
            return i
        i = src.skip_angles(i)
        if types and src.word(i) and src.is_(i + 1, "(") and src.tokens[i].text == types[-1]:
            return self.callable(first, i, "", "constructor", types, after)
        if types and src.word(i) and src.is_(i + 1, "{") and src.tokens[i].text == types[-1]:
            return src.match[i + 1]
        j = self.type_text(self.modifiers(i))
        if j > i and src.word(j) and src.is_(j + 1, "("):
            return self.callable(first, j, src.between(self.modifiers(i), j - 1) + " ", "method", types, after)
        while i < len(src.tokens) and not src.is_(i, ";"):  # a field
            if src.is_(i, "}"):
                return max(first, i - 1)
            i = src.match[i] + 1 if src.is_(i, "(", "[", "{") else i + 1
        return min(i, len(src.tokens) - 1)

    def callable(self, first: int, name_at: int, lead: str, kind: str, types: tuple[str, ...], after: int) -> int:
        src, name, close = self.src, self.src.tokens[name_at].text, self.src.match[name_at + 1]
        i = close + 1
        while i < len(src.tokens) and not src.is_(i, "{", ";", "}"):
            i = src.match[i] + 1 if src.is_(i, "(", "[") else i + 1
        last = src.match[i] if src.is_(i, "{") else min(i, len(src.tokens) - 1)
        signature = f"{lead}{name}{src.between(name_at + 1, close)}"
        self.out.append(symbol(name, self.qualify(types, name), kind, signature, src.line(src.tokens[first].begin), src.line(src.tokens[last].begin), src.block_doc(first, after)))
        return last

    def type_(self, first: int, i: int, types: tuple[str, ...], after: int) -> int:
        src = self.src
        kind, name = _TYPES[src.tokens[i].text], src.tokens[i + 1].text
        j = src.skip_angles(i + 2)
        signature = f"{kind} {name}"
        if kind == "record":
            signature += src.between(j, src.match[j])
            j = src.match[j] + 1
        while j < len(src.tokens) and not src.is_(j, "{", ";"):
            if src.is_(j, "extends", "implements", "permits"):
                word = src.tokens[j].text
                found, j = self.names(j + 1)
                if found and word != "permits" and kind != "record":
                    signature += f" {word} {', '.join(found)}"
            else:
                j += 1
        last = src.match[j] if src.is_(j, "{") else min(j, len(src.tokens) - 1)
        self.out.append(symbol(name, self.qualify(types, name), kind, signature, src.line(src.tokens[first].begin), src.line(src.tokens[last].begin), src.block_doc(first, after)))
        if src.is_(j, "{"):
            self.body(j, last, (*types, name), kind == "enum")
        return last

    def body(self, open_at: int, close_at: int, types: tuple[str, ...], enum: bool) -> None:
        src, i, after = self.src, open_at + 1, self.src.tokens[open_at].end
        while enum and i < close_at and not src.is_(i, ";"):
            first = i
            i = self.modifiers(i)
            if src.word(i):
                name, last = src.tokens[i].text, i
                for mark in ("(", "{"):
                    if src.is_(last + 1, mark):
                        last = src.match[last + 1]
                self.out.append(symbol(name, self.qualify(types, name), "enum_constant", name, src.line(src.tokens[first].begin), src.line(src.tokens[last].begin), src.block_doc(first, after)))
                after, i = src.tokens[last].end, last + 1
            if i == first or src.is_(i, ","):
                i += 1
        i += enum and src.is_(i, ";")
        while i < close_at:
            last = self.member(i, types, after)
            after, i = src.tokens[min(last, len(src.tokens) - 1)].end, max(last, i) + 1


def extract(text: str, module: str) -> list[dict]:
    return _Reader(text, module).top()


def imports(text: str) -> list[str]:
    """Dotted names of import declarations, without ``static`` and ``.*``."""
    src, out = Source(text, "java"), []
    for i, t in enumerate(src.tokens):
        if t.kind == "word" and t.text == "import":
            j = i + 1 + src.is_(i + 1, "static")
            name = []
            while src.word(j) or src.is_(j, ".") and src.word(j + 1):
                name.append(src.tokens[j].text)
                j += 1
            if name:
                out.append("".join(name))
    return out

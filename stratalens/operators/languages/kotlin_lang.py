"""Kotlin symbols: types, objects, functions, properties and enum entries."""

from __future__ import annotations

from .lexer import Source, symbol

_MODIFIERS = frozenset(
    "public private internal protected abstract open final sealed data annotation enum inner value override lateinit const suspend inline infix operator tailrec external expect actual vararg noinline crossinline reified fun".split()
) - {"fun"}
_GOES_ON = frozenset(". ?. ?: + - * / % = && || , -> :: : as is in !in ( [ { ?".split())


class _Reader:
    def __init__(self, text: str, module: str):
        self.src, self.out, self.package = Source(text, "kotlin"), [], module

    def qualify(self, types: tuple[str, ...], name: str) -> str:
        return ".".join([*([self.package] if self.package else []), *types, name])

    def add(self, name: str, types: tuple[str, ...], kind: str, signature: str, first: int, last: int, after: int) -> None:
        src, last = self.src, min(last, len(self.src.tokens) - 1)
        if not name:
            return
        self.out.append(symbol(name, self.qualify(types, name), kind, signature, src.line(src.tokens[first].begin), src.line(src.tokens[last].begin), src.block_doc(first, after)))

    def modifiers(self, i: int) -> tuple[int, list[str]]:
        src, words = self.src, []
        while i < len(src.tokens):
            if src.is_(i, "@"):
                i += 2
                while src.is_(i, ".", ":") and src.word(i + 1):
                    i += 2
                i = src.match[i] + 1 if src.is_(i, "(") else i
            elif src.word(i) and src.tokens[i].text in _MODIFIERS and (src.word(i + 1) or src.is_(i + 1, "@")):
                words.append(src.tokens[i].text)
                i += 1
            else:
                break
        return i, words

    def user_type(self, i: int) -> int:
        """Index after a plain (dotted, generic) type at i; i if there is none."""
        src = self.src
        j = i
        while src.word(j):
            j = src.skip_angles(j + 1)
            if not (src.is_(j, ".") and src.word(j + 1)):
                return j
            j += 1
        return i

    def expression_end(self, i: int) -> int:
        """Last token of an expression that starts at i: to the line's end, unless it goes on."""
        src = self.src
        while i < len(src.tokens):
            end = src.match[i] if src.is_(i, "(", "[", "{") else i
            nxt = end + 1
            if nxt >= len(src.tokens) or src.is_(nxt, "}", ")", ";"):
                return end
            if src.new_line(nxt) and not (src.tokens[end].text in _GOES_ON and end == i) and not src.is_(nxt, ".", "?", "&", "|", "else", "+", "*", "/", "->"):
                return end
            i = nxt
        return len(src.tokens) - 1

    def declarations(self, i: int, stop: int, types: tuple[str, ...], after: int) -> None:
        while i < stop:
            last = self.declaration(i, types, after)
            after, i = self.src.tokens[min(last, len(self.src.tokens) - 1)].end, max(last, i) + 1

    def top(self) -> list[dict]:
        src, i, after = self.src, 0, 0
        while src.is_(i, "@") and src.is_(i + 1, "file"):
            i += 1
            while i < len(src.tokens) and not src.new_line(i):
                i += 1
        while src.is_(i, "package", "import"):
            j = i + 1
            while j < len(src.tokens) and not src.new_line(j) and not src.is_(j, ";"):
                j += 1
            if src.is_(i, "package") and j > i + 1:
                self.package = src.between(i + 1, j - 1)
            after, i = src.tokens[j - 1].end, j + src.is_(j, ";")
        self.declarations(i, len(src.tokens), (), after)
        return self.out

    def declaration(self, first: int, types: tuple[str, ...], after: int) -> int:
        src = self.src
        i, words = self.modifiers(first)
        if src.is_(i, "companion") and src.is_(i + 1, "object"):
            j = i + 2
            name = src.tokens[j].text if src.word(j) and not src.new_line(j) else "Companion"
            return self.container(first, j + (name != "Companion" or src.is_(j, "Companion")), name, "class", f"companion object {name}", types, after)
        if src.is_(i, "class", "interface") or src.is_(i, "fun") and src.is_(i + 1, "interface"):
            i += src.is_(i, "fun")
            name = src.tokens[i + 1].text if src.word(i + 1) else ""
            kind = "interface" if src.is_(i, "interface") else "enum" if "enum" in words else "class"
            shown = [w for w in words if w in ("data", "sealed", "annotation", "abstract", "open")]
            head = {"interface": "interface", "enum": "enum class"}.get(kind, " ".join([*shown, "class"]))
            return self.container(first, i + 2, name, kind, f"{head} {name}", types, after)
        if src.is_(i, "object") and src.word(i + 1):
            name = src.tokens[i + 1].text
            return self.container(first, i + 2, name, "class", f"object {name}", types, after)
        if src.is_(i, "fun"):
            return self.function(first, i, types, after)
        if src.is_(i, "val", "var"):
            return self.property(first, i, words, types, after)
        if src.is_(i, "init", "constructor"):
            j = i + 1
            j = src.match[j] + 1 if src.is_(j, "(") else j
            while src.is_(j, ":", "this", "super"):
                j += 1
                j = src.match[j] + 1 if src.is_(j, "(") else j
            return src.match[j] if src.is_(j, "{") else j - 1
        return self.expression_end(i)

    def container(self, first: int, i: int, name: str, kind: str, signature: str, types: tuple[str, ...], after: int) -> int:
        src = self.src
        i = src.skip_angles(i)
        last = i - 1
        j, words = self.modifiers(i)
        if src.is_(j, "constructor"):
            i = j + 1
        if src.is_(i, "(") and (not src.new_line(i) or src.is_(i - 1, "constructor")):
            signature += src.between(i, src.match[i])
            last, i = src.match[i], src.match[i] + 1
        if src.is_(i, ":"):
            begin = i + 1
            i = begin
            while True:
                i = self.user_type(i)
                if src.is_(i, "(") and not src.new_line(i):
                    i = src.match[i] + 1
                if src.is_(i, "by"):
                    i = self.user_type(i + 1)
                    i = src.match[i] + 1 if src.is_(i, "(") else i
                if not src.is_(i, ",") or i <= begin:
                    break
                i += 1
            if i > begin:
                signature += f" : {src.between(begin, i - 1)}"
                last = i - 1
        if src.is_(i, "where"):
            while i < len(src.tokens) and not src.is_(i, "{") and not (src.new_line(i) and not src.is_(i - 1, ",")):
                i += 1
        last = min(last, len(src.tokens) - 1)
        body = i if src.is_(i, "{") else None
        if body is not None:
            last = src.match[body]
        self.add(name, types, kind, signature, first, max(last, first), after)
        if body is not None:
            self.body(body, last, (*types, name), kind == "enum")
        return max(last, first)

    def body(self, open_at: int, close_at: int, types: tuple[str, ...], enum: bool) -> None:
        src, i, after = self.src, open_at + 1, self.src.tokens[open_at].end
        while enum and i < close_at and not src.is_(i, ";"):
            first = i
            i, _ = self.modifiers(i)
            if not src.word(i) or src.is_(i, "fun", "val", "var", "companion"):
                break
            last = i
            for mark in ("(", "{"):
                if src.is_(last + 1, mark):
                    last = src.match[last + 1]
            self.add(src.tokens[i].text, types, "enum_constant", src.tokens[i].text, first, last, after)
            after, i = src.tokens[last].end, last + 1
            i += src.is_(i, ",")
        i += enum and src.is_(i, ";")
        self.declarations(i, close_at, types, after)

    def function(self, first: int, i: int, types: tuple[str, ...], after: int) -> int:
        src = self.src
        j = src.skip_angles(i + 1)
        begin = j
        j = src.match[j] + 1 if src.is_(j, "(") and src.is_(src.match[j] + 1, ".") else j
        dots = []
        while src.word(j) or src.is_(j, ".", "?"):
            if src.is_(j, "."):
                dots.append(j)
            j = src.skip_angles(j + 1) if src.word(j) and not src.is_(j + 1, "(") else j + 1
            if src.is_(j, "("):
                break
        name = src.tokens[j - 1].text if j > begin else ""
        receiver = src.between(begin, dots[-1] - 1) if dots and src.word(begin) and not src.is_(dots[-1] - 1, "?") else ""
        if not src.is_(j, "("):
            return self.expression_end(i)
        signature = f"fun {receiver}.{name}" if receiver else f"fun {name}"
        signature += src.between(j, src.match[j])
        last, k = src.match[j], src.match[j] + 1
        if src.is_(k, ":"):
            end = self.user_type(k + 1)
            if end > k + 1 and not src.is_(end, "?", "->"):
                signature += f": {src.between(k + 1, end - 1)}"
            k = end
            while k < len(src.tokens) and not src.is_(k, "{", "=", "}") and not src.new_line(k):
                k = src.match[k] + 1 if src.is_(k, "(", "[") else k + 1
            last = k - 1
        if src.is_(k, "{"):
            last = src.match[k]
        elif src.is_(k, "="):
            last = self.expression_end(k)
        self.add(name, types, "method" if types else "function", signature, first, last, after)
        return last

    def property(self, first: int, i: int, words: list[str], types: tuple[str, ...], after: int) -> int:
        src = self.src
        j = src.skip_angles(i + 1)
        while src.word(j) and src.is_(j + 1, ".") and src.word(j + 2):
            j += 2
        if not src.word(j):
            return self.expression_end(i)
        name, last, typed = src.tokens[j].text, j, ""
        k = j + 1
        if src.is_(k, ":"):
            end = self.user_type(k + 1)
            if end > k + 1 and not src.is_(end, "?", "->"):
                typed = f": {src.between(k + 1, end - 1)}"
            while end < len(src.tokens) and not src.is_(end, "=", "}", ";", "by") and not src.new_line(end):
                end = src.match[end] + 1 if src.is_(end, "(", "[") else end + 1
            last, k = end - 1, end
        if src.is_(k, "=", "by"):
            last = self.expression_end(k)
        while src.is_(last + 1, "get", "set") and (src.is_(last + 2, "(") or src.new_line(last + 2)):
            k = last + 2
            last = src.match[k] if src.is_(k, "(") else last + 1
            if src.is_(last + 1, "{"):
                last = src.match[last + 1]
            elif src.is_(last + 1, "="):
                last = self.expression_end(last + 1)
        shown = [w for w in words if w in ("const", "lateinit", "private", "public", "internal", "protected")]
        self.add(name, types, "constant" if "const" in words else "property", " ".join([*shown, src.tokens[i].text, name]) + typed, first, last, after)
        return last


def extract(text: str, module: str) -> list[dict]:
    return _Reader(text, module).top()

"""A small lexer for the brace languages: tokens with positions, comments apart."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(frozen=True)
class Token:
    kind: str  # word, string, mark
    text: str
    begin: int
    end: int


class Source:
    """Text with its tokens, its comments, and matching brackets."""

    PATTERNS = {
        "go": r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')",
        "java": r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')",
        "kotlin": r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')",
        "gleam": r"(?P<comment>//[^\n]*)|(?P<string>\"(?:\\.|[^\"\\])*\")",
        "erlang": r"(?P<comment>%[^\n]*)|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\$(?:\\.|[^\\]))",
    }

    def __init__(self, text: str, language: str):
        self.text = text
        self.tokens: list[Token] = []
        self.comments: list[Token] = []
        scan = re.compile(self.PATTERNS[language] + r"|(?P<word>`[^`\n]+`|[^\W\d]\w*|\d[\w.]*)|(?P<mark>->|::|:-|[^\s\w])", re.S)
        for m in scan.finditer(text):
            own = Token(m.lastgroup, m[0], m.start(), m.end())
            (self.comments if own.kind == "comment" else self.tokens).append(own)
        self._lines = [m.start() for m in re.finditer("\n", text)]
        self._comment_ends = [c.end for c in self.comments]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                while stack and OPEN[self.tokens[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    self.match[stack.pop()] = i
        for i in stack:
            self.match.setdefault(i, len(self.tokens) - 1)

    def line(self, at: int) -> int:
        return bisect.bisect_left(self._lines, at) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "string"

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def between(self, i: int, j: int) -> str:
        """Source text from token i to token j, both included."""
        return self.text[self.tokens[i].begin : self.tokens[j].end]

    def new_line(self, i: int) -> bool:
        """Whether token i begins a line after token i - 1."""
        return i == 0 or "\n" in self.text[self.tokens[i - 1].end : self.tokens[i].begin]

    def skip_angles(self, i: int) -> int:
        """Index after a balanced <...> that starts at i, or i."""
        if not self.is_(i, "<"):
            return i
        depth = 0
        while i < len(self.tokens):
            if self.is_(i, "<"):
                depth += 1
            elif self.is_(i, ">"):
                depth -= 1
                if not depth:
                    return i + 1
            elif self.is_(i, "(", "["):
                i = self.match[i]
            elif self.is_(i, "{", "}", ";"):
                return i
            i += 1
        return i

    def comments_before(self, i: int, after: int) -> list[Token]:
        """Comments between position ``after`` and token i."""
        hi = bisect.bisect_right(self._comment_ends, self.tokens[i].begin)
        lo = bisect.bisect_right(self._comment_ends, after)
        return self.comments[lo:hi]

    def block_doc(self, i: int, after: int) -> str | None:
        """Text of a /** */ comment that comes last before token i."""
        found = self.comments_before(i, after)
        if not found or not found[-1].text.startswith("/**"):
            return None
        inner = found[-1].text[3:].removesuffix("*/")
        lines = (x.strip().lstrip("*").strip() for x in inner.splitlines())
        return " ".join(x for x in lines if x) or None


def symbol(name: str, qualified: str, kind: str, signature: str, start: int, end: int, doc: str | None) -> dict:
    return {"name": name, "qualified_name": qualified, "kind": kind, "signature": signature, "start_line": start, "end_line": end, "docstring": doc}

"""Python symbols: the standard parser, and an indentation reader for files it rejects."""

from __future__ import annotations

import ast
import re

from .lexer import symbol

_LITERAL = re.compile(r"^[rRbBuU]{0,2}(\"\"\"|'''|\"|')(.*)\1$", re.S)


def _bracket_end(text: str, at: int) -> int:
    """Index after the bracket that matches the one at ``at``, minding strings and comments."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i + 1
        elif c == "#":
            i = text.find("\n", i)
            if i < 0:
                return len(text)
        elif c in "\"'":
            quote = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
            i += len(quote)
            while i < len(text) and text[i : i + len(quote)] != quote:
                i += 2 if text[i] == "\\" else 1
            i += len(quote) - 1
        i += 1
    return len(text)


def _after_name(text: str, at: int, keyword: str, name: str) -> str:
    """The parenthesised text behind ``keyword name`` (and type parameters), or empty."""
    m = re.compile(rf"{keyword}\s+{re.escape(name)}\s*").search(text, at)
    if not m:
        return ""
    i = m.end()
    if text[i : i + 1] == "[":
        i = _bracket_end(text, i)
        while text[i : i + 1].isspace():
            i += 1
    return text[i : _bracket_end(text, i)] if text[i : i + 1] == "(" else ""


def _docstring(body: list[ast.stmt], text: str, starts: list[int]) -> str | None:
    if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, ast.Constant) or not isinstance(body[0].value.value, str):
        return None
    own = body[0].value
    raw = text.encode()[_at(own.lineno, own.col_offset, starts) : _at(own.end_lineno, own.end_col_offset, starts)].decode(errors="replace")
    m = _LITERAL.match(raw)
    return (m[2] or None) if m else None


def _at(line: int, col: int, starts: list[int]) -> int:
    return starts[line - 1] + col


def extract(text: str, module: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _by_indentation(text, module)
    raw = text.encode()
    starts = [0]
    for line in raw.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    out: list[dict] = []

    def visit(node: ast.AST, classes: tuple[str, ...]) -> None:
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            is_class = isinstance(node, ast.ClassDef)
            at = len(raw[: _at(node.lineno, node.col_offset, starts)].decode(errors="replace"))
            inside = _after_name(text, at, "class" if is_class else "def", node.name)
            if is_class:
                bases = inside.strip("()")
                signature = f"class {node.name}({bases})" if bases else f"class {node.name}"
                kind = "class"
            else:
                signature = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}{inside or '()'}"
                kind = "function" if not classes else "constructor" if node.name == "__init__" else "method"
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append(symbol(node.name, ".".join([module, *classes, node.name]), kind, signature, start, node.end_lineno, _docstring(node.body, text, starts)))
            if is_class:
                for child in node.body:
                    visit(child, (*classes, node.name))
            return
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.stmt | ast.ExceptHandler | ast.match_case):
                visit(child, classes)

    visit(tree, ())
    return out


def _by_indentation(text: str, module: str) -> list[dict]:
    """Classes and functions of a file with syntax errors, from headers and indentation."""
    lines = text.splitlines()
    out: list[dict] = []
    open_blocks: list[tuple[int, str, str, dict]] = []  # indent, kind, name, row
    decorator: int | None = None
    for no, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while open_blocks and indent <= open_blocks[-1][0]:
            open_blocks.pop()
        for block in open_blocks:
            block[3]["end_line"] = no
        if bare.startswith("@"):
            decorator = decorator or no
            continue
        m = re.match(r"(class|(?:async\s+)?def)\s+(\w+)", bare)
        if m and not any(k == "def" for _, k, _, _ in open_blocks):
            kind = "class" if m[1] == "class" else "def"
            classes = [n for _, _, n, _ in open_blocks]
            at = sum(len(x) + 1 for x in lines[: no - 1])
            inside = _after_name(text, at, kind, m[2])
            if kind == "class":
                bases = inside.strip("()")
                row = symbol(m[2], ".".join([module, *classes, m[2]]), "class", f"class {m[2]}({bases})" if bases else f"class {m[2]}", decorator or no, no, None)
            else:
                what = "function" if not classes else "constructor" if m[2] == "__init__" else "method"
                row = symbol(m[2], ".".join([module, *classes, m[2]]), what, f"{'async ' if m[1] != 'def' else ''}def {m[2]}{inside or '()'}", decorator or no, no, None)
            out.append(row)
            open_blocks.append((indent, kind, m[2], row))
        elif out and open_blocks and out[-1] is open_blocks[-1][3] and out[-1]["docstring"] is None and out[-1]["end_line"] == no:
            quoted = _LITERAL.match(bare)
            if quoted:
                out[-1]["docstring"] = quoted[2] or None
        decorator = None
    return out


def imports(text: str) -> list[tuple[str, str | None]]:
    """(module, name or None) of the top-level import statements."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        found: list[tuple[str, str | None]] = []
        for m in re.finditer(r"^(?:from\s+([\w.]+)\s+import\s+([\w, ]+)|import\s+([\w., ]+))", text, re.M):
            if m[1]:
                found += [(m[1], n.split(" as ")[0].strip()) for n in m[2].split(",") if n.strip()]
            else:
                found += [(n.split(" as ")[0].strip(), None) for n in m[3].split(",") if n.strip()]
        return found
    found = []
    for node in body:
        if isinstance(node, ast.Import):
            found += [(a.name, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            found += [(module, a.name) for a in node.names if module and a.name != "*"]
    return found


def skeleton(source: str, kind: str) -> str:
    """A class with the bodies of its methods replaced by "..."; anything else unchanged."""
    if kind != "class":
        return source
    out: list[str] = []
    inside: int | None = None
    for line in source.splitlines():
        bare = line.lstrip()
        depth = len(line) - len(bare)
        if bare and inside is not None:
            if depth > inside:
                continue
            inside = None
        out.append(line)
        if bare and depth and re.match(r"(?:async\s+)?def\s", bare):
            if not line.rstrip().endswith(":"):
                out[-1] = line.rstrip(":") + ":"
            out.append(f"{'':{depth + 4}}...")
            inside = depth
    return "\n".join(out)

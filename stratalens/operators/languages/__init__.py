"""Languages by suffix, and their extractors; more can be registered."""

from __future__ import annotations

from collections.abc import Callable

from . import beam_langs, go_lang, java_lang, kotlin_lang, python_lang

EXTENSIONS = {".py": "python", ".go": "go", ".java": "java", ".gleam": "gleam", ".erl": "erlang", ".hrl": "erlang", ".kt": "kotlin", ".kts": "kotlin"}
EXTRACTORS: dict[str, Callable[[str, str], list[dict]]] = {
    "python": python_lang.extract,
    "go": go_lang.extract,
    "java": java_lang.extract,
    "kotlin": kotlin_lang.extract,
    "gleam": beam_langs.extract_gleam,
    "erlang": beam_langs.extract_erlang,
}
SKELETONS: dict[str, Callable[[str, str], str]] = {"python": python_lang.skeleton}


def register(language: str, extensions: list[str], extract: Callable[[str, str], list[dict]]) -> None:
    """Adds or replaces a language."""
    EXTRACTORS[language] = extract
    EXTENSIONS.update(dict.fromkeys(extensions, language))


def skeleton(language: str, source: str, kind: str) -> str:
    return SKELETONS.get(language, lambda s, _: s)(source, kind)


def imported_names(language: str, text: str, grouped: bool = False) -> list[tuple[str, str | None]]:
    """(module or name, imported symbol) pairs of a file; languages without import edges have none."""
    if language == "python":
        return python_lang.imports(text)
    if language == "java":
        return [(n, None) for n in java_lang.imports(text)]
    if language == "go":
        return [(n, None) for n in go_lang.imports(text, grouped)]
    return []

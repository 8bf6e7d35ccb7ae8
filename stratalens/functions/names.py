"""Names in index symbols and type signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _descriptor(symbol: Column) -> Column:
    """Fifth space-separated part and all after it; null for local symbols and shorter ones."""
    return F.when(~F.startswith(symbol, F.lit("local ")) & symbol.rlike(r"(?s)^(?:[^ ]* ){4}"), F.regexp_extract(symbol, r"(?s)^(?:[^ ]* ){4}(.*)$", 1))


def _rstrip(x: Column, char: str) -> Column:
    return F.regexp_replace(x, rf"(?:{char})+$", "")


def go_name(symbol: Column) -> Column:
    """package.Type.Method of a Go index symbol, or null."""
    desc = F.regexp_replace(_rstrip(_descriptor(symbol), r"\."), r"\([^)]*\)$", "")
    typed = F.contains(desc, F.lit("#"))
    package = F.substring_index(F.regexp_extract(desc, r"(?s)^(.*)/[^/]*$", 1), "/", -1)
    rest = F.substring_index(desc, "/", -1)
    kind, member = F.substring_index(rest, "#", 1), F.regexp_extract(rest, r"(?s)^[^#]*#(.*)$", 1)
    with_type = F.when(member != "", F.concat_ws(".", package, kind, member)).otherwise(F.concat_ws(".", package, kind))
    plain = F.when(rest != "", F.concat_ws(".", package, rest))
    return F.when(F.contains(desc, F.lit("/")), F.when(typed, with_type).otherwise(plain))


def python_name(symbol: Column) -> Column:
    """module.Type.method of a Python index symbol, or null for meta symbols and parameters."""
    desc = _descriptor(symbol)
    module = F.regexp_extract(desc, r"(?s)^`([^`]*)`", 1)
    rest = _rstrip(F.regexp_extract(desc, r"(?s)^`[^`]*`/(.*)$", 1), r"\.")
    wrong = rest.rlike(r"(?s):$") | (rest.rlike(r"(?s)\)$") & ~rest.rlike(r"(?s)\(\)$"))
    name = F.regexp_replace(rest, r"\(\)$", "")
    kind, member = F.substring_index(name, "#", 1), F.regexp_extract(name, r"(?s)^[^#]*#(.*)$", 1)
    typed = F.when(member != "", F.concat_ws(".", module, kind, member)).otherwise(F.concat_ws(".", module, kind))
    found = F.when(F.contains(name, F.lit("#")), typed).otherwise(F.concat_ws(".", module, name))
    return F.when(desc.rlike(r"(?s)^`[^`]*`/") & ~wrong & (name != ""), found)


def java_name(symbol: Column) -> Column:
    """package.Type.member of a Java index symbol, or null."""
    desc = F.substring_index(_rstrip(_descriptor(symbol), r"\."), "(", 1)
    return F.when(desc != "", _rstrip(F.translate(desc, "/#", ".."), r"\."))


def python_bases(signature: Column) -> Column:
    """Base classes as written in a class signature, trimmed, without empty ones."""
    inside = F.regexp_extract(signature, r"^class\s+\w+\s*\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_base(base: Column) -> Column:
    """A base without subscripts, calls and type arguments."""
    return F.trim(F.regexp_replace(base, r"(?s)[\[(<].*$", ""))


def java_supertypes(signature: Column) -> Column:
    """Names after extends, then those after implements."""

    def after(keyword: str, other: str) -> Column:
        raw = F.regexp_extract(signature, rf"\b{keyword}\s+([\w,\s<>]+)", 1)
        raw = F.substring_index(raw, other, 1)
        names = F.transform(F.split(raw, ","), lambda x: F.regexp_extract(F.trim(x), r"^([^<\s]*)", 1))
        return F.filter(names, lambda x: x != "")

    return F.concat(after("extends", "implements"), after("implements", "extends"))

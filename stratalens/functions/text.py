"""Scalar expressions over paths, names and symbol text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_of(path: Column) -> Column:
    """Parent folder of a relative path; "." at the root."""
    return F.coalesce(F.nullif(F.regexp_replace(path, r"/?[^/]*$", ""), F.lit("")), F.lit("."))


def module_of(path: Column) -> Column:
    """Dotted module name: last suffix cut, a trailing __init__ dropped unless nothing would be left."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), "/", ".")
    short = F.regexp_replace(bare, r"(^|\.)__init__$", "")
    return F.when(short == "", "__init__").otherwise(short)


def suffix_of(path: Column) -> Column:
    """Last suffix of the file name with its dot, or empty (a leading dot starts no suffix)."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)$", 1)


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def first_part(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def shown_name(qualified: Column, name: Column) -> Column:
    """qualified name, or name where it is null or empty."""
    return F.coalesce(F.nullif(qualified, F.lit("")), name)


def symbol_text(qualified: Column, name: Column, signature: Column, docstring: Column) -> Column:
    """What a symbol is hashed and embedded by: name, signature if it says more, docstring."""
    sig = F.when((signature != "") & (signature != name), signature)
    return F.concat_ws(" ", shown_name(qualified, name), sig, F.nullif(docstring, F.lit("")))


def symbol_hash(qualified: Column, name: Column, signature: Column, docstring: Column) -> Column:
    return F.sha2(symbol_text(qualified, name, signature, docstring), 256)


def member_hash(content_hash: Column) -> Column:
    """Aggregate: sha256 over the sorted hashes of a concept's members (null counts as empty)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.coalesce(content_hash, F.lit("")))), ""), 256)


def set_digest(content_hash: Column) -> Column:
    """Aggregate: a digest of a multiset of sha256 hashes in hexadecimal, whatever their order.

    Sums of four stretches of the hashes and their number, so that partitions combine and no list is gathered."""
    part = lambda i: F.sum(F.conv(F.substring(content_hash, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws(":", F.count(content_hash), *[F.coalesce(part(i), F.lit(0)).cast("string") for i in range(4)]), 256)


def concept_label(name: Column, concept_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("concept_"), concept_id.cast("string")))


def excluded(path: Column, paths: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Whether a path lies at or below one of ``paths``, or a pattern is found in it
    or in one of its folders below the first."""
    out = F.lit(False)
    for p in paths:
        p = p.rstrip("/")
        out = out | (path == p) | F.startswith(path, F.lit(f"{p}/"))
    if patterns:
        parts = F.split(path, "/")
        above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        folders = F.when(F.size(parts) > 2, above).otherwise(F.array().cast("array<string>"))
        for r in patterns:
            out = out | path.rlike(r) | _any_match(folders, r)
    return out


def _any_match(items: Column, pattern: str) -> Column:
    return F.exists(items, lambda x: x.rlike(pattern))


def cluster_count(n: Column, size: int = 20) -> Column:
    """Concepts for a package of n symbols: n / size, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(n / size).cast("int"))


def parsed_score(reply: Column, fallback: Column) -> Column:
    """First word of a reply as a number, else ``fallback``."""
    word = F.element_at(F.split(F.trim(reply), r"\s+"), 1)
    return F.coalesce(word.try_cast("double"), fallback)

"""Symbols of source files, as a table function over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import module_of, symbol_hash
from .languages import EXTRACTORS, imported_names

_FIELDS = ["name", "qualified_name", "kind", "signature", "start_line", "end_line", "docstring"]


def extract_symbols(files: DataFrame) -> DataFrame:
    """Rows of the symbols table for files with content.

    A symbol's key is its file, qualified name, signature and the ordinal among
    equals; symbol_id is a hash of it, so ids survive edits elsewhere."""
    extractors = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f in b.itertuples(index=False):
                extract = extractors.get(f.language)
                text = bytes(f.content).decode("utf-8", "replace") if f.content is not None else ""
                for s in extract(text, f.module) if extract else ():
                    rows.append((f.file_id, f.path, f.language, *(s[k] for k in _FIELDS)))
            yield pd.DataFrame(rows, columns=["file_id", "path", "language", *_FIELDS]).astype({"start_line": "int32", "end_line": "int32", "file_id": "int64"})

    found = files.select("file_id", "path", "language", "content", module_of(F.col("path")).alias("module")).mapInPandas(run, f"file_id long, path string, language string, {schema.EXTRACTED}")
    same = Window.partitionBy("file_id", "qualified_name", "signature").orderBy("start_line", "end_line")
    found = found.withColumn("ordinal", F.row_number().over(same).cast("int"))
    return found.select(
        F.xxhash64("path", "qualified_name", "signature", "ordinal").alias("symbol_id"), "file_id", "path", "language", *_FIELDS, "ordinal",
        symbol_hash(F.col("qualified_name"), F.col("name"), F.col("signature"), F.col("docstring")).alias("content_hash"),
    )


def extract_imports(files: DataFrame, grouped: bool = False) -> DataFrame:
    """path, language, module, name (null where a whole module is imported); ``grouped``: Go imports in parentheses count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f.path, f.language, m, n) for f in b.itertuples(index=False) for m, n in imported_names(f.language, bytes(f.content or b"").decode("utf-8", "replace"), grouped)]
            yield pd.DataFrame(rows, columns=["path", "language", "module", "name"])

    wanted = files.filter(F.col("language").isin("python", "java", "go"))
    return wanted.select("path", "language", "content").mapInPandas(run, "path string, language string, module string, name string")

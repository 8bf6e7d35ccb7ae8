"""Code-index files (protocol buffers) decoded to occurrences, without a schema compiler."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_log = logging.getLogger(__name__)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at
        if shift > 63:
            raise ValueError("varint too long")


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field number, wire type, value) of a message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated message")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield number, wire, value


def _packed(wire: int, value: int | bytes) -> list[int]:
    if wire == 0:
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x)
    return out


def occurrences(data: bytes) -> list[tuple[str, str, int, int | None]]:
    """(path, symbol, roles, line from 0 or None) of an index: documents are field 2,
    their path field 1 and occurrences field 2; of those range 1, symbol 2, roles 3."""
    out = []
    for number, _, doc in fields(data):
        if number != 2:
            continue
        path, own = "", []
        for n, wire, value in fields(doc):
            if n == 1:
                path = value.decode("utf-8", "replace")
            elif n == 2 and wire == 2:
                spot: list[int] = []
                symbol, roles = "", 0
                for m, w, v in fields(value):
                    if m == 1:
                        spot += _packed(w, v)
                    elif m == 2:
                        symbol = v.decode("utf-8", "replace")
                    elif m == 3:
                        roles = v
                own.append((symbol, roles, spot[0] if spot else None))
        out += [(path, *o) for o in own]
    return out


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """path, symbol, roles, line of the index files at ``path``; a file that can't be decoded gives none and a warning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for content in b["content"]:
                try:
                    rows += occurrences(bytes(content))
                except (ValueError, IndexError, AttributeError, TypeError) as e:
                    _log.warning("index not decoded: %s", e)
            yield pd.DataFrame(rows, columns=["path", "symbol", "roles", "line"]).astype({"line": "Int64", "roles": "int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "path string, symbol string, roles long, line long")

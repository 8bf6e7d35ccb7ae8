"""Vector expressions; arithmetic is in double."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-10))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean by keys, as array<double>.  Sums are combined before the
    shuffle; a group's vectors are never gathered."""
    parts = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


class Encoder(Protocol):
    """Turns texts into vectors; name is stored with them."""

    name: str

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedTrigrams:
    """Deterministic encoder: signed hashed words and character trigrams, unit length."""

    def __init__(self, dims: int = 128):
        self.dims, self.name = dims, f"hashed-trigrams-{dims}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in enumerate(texts):
            low = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text or "").lower()
            words = re.findall(r"[a-z0-9]+", low)
            for w in [*words, *(f"#{w}#"[i : i + 3] for w in words for i in range(len(w)))]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dims] += 1.0 if h >> 63 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(length, 1e-10)


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """df with a vector column, encoded in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(encoder(texts.fillna("").tolist()), np.float32)), index=texts.index)

    return df.withColumn(out, run(F.col(text)))

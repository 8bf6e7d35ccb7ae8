"""Retrieval evaluation: recall at k for fixtures and its mean over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import Searcher


def recall_at_k(expected: Column, retrieved: Column, k: Column) -> Column:
    """Share of the expected entries (repeats count) among the first k retrieved; 1 if nothing is expected."""
    first = F.slice(retrieved, F.lit(1), k)
    hits = F.size(F.filter(expected, lambda x: F.array_contains(first, x)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.greatest(F.size(expected), F.lit(1)))


def recalls(cases: DataFrame, ks: list[int]) -> DataFrame:
    """fixture, k, file_recall, symbol_recall for (fixture, expected_files, expected_symbols, files, symbols)."""
    rows = cases.withColumn("k", F.explode(F.lit(ks)))
    return rows.select("fixture", "k", recall_at_k(F.col("expected_files"), F.col("files"), F.col("k")).alias("file_recall"), recall_at_k(F.col("expected_symbols"), F.col("symbols"), F.col("k")).alias("symbol_recall"))


def macro_average(rows: DataFrame) -> DataFrame:
    """k, file_recall, symbol_recall: means over fixtures."""
    return rows.groupBy("k").agg(F.avg("file_recall").alias("file_recall"), F.avg("symbol_recall").alias("symbol_recall"))


def flatten(results: list[dict]) -> tuple[list[str], list[str]]:
    """Files and symbols in the order of the ranked concepts, each once."""
    files = dict.fromkeys(f["path"] for r in results for f in r["files"])
    symbols = dict.fromkeys(s["qualified_name"] for r in results for f in r["files"] for s in f["symbols"])
    return list(files), list(symbols)


def run(searcher: Searcher, fixtures: DataFrame, ks: list[int], backend=None, rerank: bool = False) -> tuple[DataFrame, DataFrame]:
    """(recalls per fixture, macro average) for fixtures (fixture, question, expected_files, expected_symbols).

    Fixtures are a small hand-written set; each is one question."""
    cases = []
    for f in fixtures.orderBy("fixture").collect():
        files, symbols = flatten(searcher.query(f.question, max(ks), backend, rerank))
        cases.append((f.fixture, list(f.expected_files), list(f.expected_symbols), files, symbols))
    kinds = "fixture string, expected_files array<string>, expected_symbols array<string>, files array<string>, symbols array<string>"
    per_fixture = recalls(fixtures.sparkSession.createDataFrame(cases, kinds), ks)
    return per_fixture, macro_average(per_fixture)

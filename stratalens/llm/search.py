"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are integers; a dimension is a term and its non-zero components are the
term's postings.  Each term of a block of queries scatters its weighted postings
into a dense score array (queries x candidates); every partition keeps the best of
each query as it streams through its candidates, and the partitions' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize
from ._text import give_back

#: Queries and candidates of one score array; bytes of the queries of one wave.
QUERY_BLOCK, CANDIDATES, WAVE_BYTES = 512, 4096, 32 << 20
_NONE = np.iinfo(np.int64).min


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Groups of rows of equal length don't matter here: rows are padded with zeros, which add nothing."""
    n = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(n.max()) if len(n) else 0
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out, n


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, term by term, of rows of integers (exact in 64 bits)."""
    out = np.zeros((len(queries), len(candidates)), np.int64)
    for d in range(min(queries.shape[1], candidates.shape[1])):
        asking = np.flatnonzero(queries[:, d])
        postings = np.flatnonzero(candidates[:, d])
        if not len(asking) or not len(postings):
            continue
        if len(asking) == len(queries) and len(postings) == len(candidates):
            out += queries[:, d][:, None] * candidates[:, d][None, :]
        else:
            out[np.ix_(asking, postings)] += queries[asking, d][:, None] * candidates[postings, d][None, :]
    return out


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The same, or an error where a score needs more than 64 bits."""
    width = min(queries.shape[1], candidates.shape[1])
    if width and len(queries) and len(candidates):
        most = (np.abs(queries[:, :width].astype(float)).max(0) * np.abs(candidates[:, :width].astype(float)).max(0)).sum()
        if most >= 2.0**62:
            exact = queries[:, :width].astype(object) @ candidates[:, :width].astype(object).T
            if max(abs(int(x)) for x in exact.ravel()) >= 2**63 - 1:
                raise OverflowError("an inner product doesn't fit into 64 bits")
            return exact.astype(np.int64)
    return scores(queries, candidates)


class Best:
    """The k best (score, smaller id first) of each of n queries, each id once with its best score."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query = self.id = self.score = np.zeros(0, np.int64)
        self.least = np.full(n, _NONE)

    def add(self, lo: int, total: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries ``lo`` on against candidates ``ids``; _NONE doesn't count."""
        least = self.least[lo : lo + len(total)]
        if len(ids) > 4 * self.k:
            # whatever is below the k-th best distinct id so far can't win; on the first block, below the k-th best column
            r, c = np.nonzero((total >= least[:, None]) & (total != _NONE))
        else:
            r, c = np.nonzero(total != _NONE)
        if len(r) > 64 * self.k * len(total) and len(np.unique(ids)) == len(ids):
            kth = np.partition(total, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            r, c = np.nonzero((total >= np.maximum(kth, least)[:, None]) & (total != _NONE))
        query, found, score = np.append(self.query, r + lo), np.append(self.id, ids[c]), np.append(self.score, total[r, c])
        order = np.lexsort((-score, found, query))
        query, found, score = query[order], found[order], score[order]
        first = np.append(True, (query[1:] != query[:-1]) | (found[1:] != found[:-1]))[: len(query)]
        query, found, score = query[first], found[first], score[first]
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        self.query, self.id, self.score = query[keep], found[keep], score[keep]


def _search(ids: np.ndarray, vectors: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                own, (vec, _) = part.column(0).to_numpy(), _matrix(part.column(1))
                for lo in range(0, len(ids), QUERY_BLOCK):
                    total = exact_scores(vectors[lo : lo + QUERY_BLOCK], vec)
                    total[ids[lo : lo + QUERY_BLOCK, None] == own[None, :]] = _NONE
                    top.add(lo, total, own)
        yield pa.RecordBatch.from_arrays([pa.array(ids[top.query]), pa.array(top.id), pa.array(top.score)], ["query_id", "vec_id", "score"])
        give_back()

    return run


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as double; rows with a null id,
    a null vector or a null or non-finite component are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(fine)
    whole = lambda c: F.floor(c.cast("double") * scale)
    fits = lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**62, whole(c)).otherwise(F.raise_error(F.lit("a component doesn't fit into 64 bits")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: fits(c).cast("long")).alias("v"))


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query by integer inner product.

    vectors: vec_id, embedding.  Queries are rows with vec_id divisible by
    ``every``; candidates are all rows of another vec_id.  Score descending, then
    vec_id ascending.

    Left out: null ids, null vectors, vectors with null or non-finite components.
    A shorter vector counts as padded with zeros.  Of rows that repeat a query's
    vec_id the smallest vector asks; a candidate repeated identically counts
    once, one repeated with other vectors counts with its best score.  Other
    columns are ignored; an empty table gives none.

    A component or a score that doesn't fit into 64 bits is an error.

    Queries go out in waves of about WAVE_BYTES, so that a wave has a bound whatever
    the table's size; each wave reads the candidates where they lie, without an exchange,
    and only the k best of each query and partition are dealt out for merging."""
    base = quantize(vectors, scale)
    asks = base.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asks = materialize(asks, "queries")
    size = asks.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    waves = max(1, -(-size // WAVE_BYTES))
    results = []
    for wave in range(waves):
        table = asks.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(waves)) == wave).toArrow().combine_chunks()
        if len(table):
            vec, _ = _matrix(table.column("v").chunk(0))
            found = base.mapInArrow(_search(table.column("id").to_numpy(), vec, k), "query_id long, vec_id long, score long")
            found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            found = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            results.append(materialize(found, "found") if waves > 1 else found)
    if not results:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out

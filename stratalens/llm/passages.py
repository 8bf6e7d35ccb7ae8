"""Removal of passages that repeat across documents.

Difference-cover anchors: shorter windows are hashed only at word positions
whose remainder modulo a period lies in a difference cover.  For any two
positions there is a shift below the period that brings both into the cover, so
two equal windows of ``window`` words always share an aligned anchor of
``window - period + 1`` words.  Anchors that occur in one document only are
dropped; around the others the full windows' words are compared by a 128-bit
digest (BLAKE2b), which extends each anchor without pairing the documents that hold it.

Passages that very many documents share would send all their anchors and windows to
one task.  A sample of documents names those that look so; their owners are found
by minima combined within each task, and they take no part in the exchanges.  The
sample only chooses the way, results are the same whatever it names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import join_keys, materialize
from ._text import U, as_long, blocks, flat_ranges, give_back, run_hashes, word_names

#: Perfect difference sets: every non-zero remainder is the difference of exactly one ordered pair.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (0, 1, 3, 8, 12, 18)}
#: Documents of the sample that looks for frequent passages, and the share of it (one in so many) that makes one.
LOOKED_AT, FREQUENT, AT_LEAST = 20_000, 1_000, 16
NONE = np.zeros(0, U)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover for windows of so many words; anchors keep at least a third of the window."""
    return max(((p, c) for p, c in COVERS.items() if 3 * (window - p + 1) >= window), default=(1, (0,)))


def _once_a_row(row: np.ndarray, pos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each row and hash, with its first and last position there."""
    order = np.lexsort((pos, h, row))
    row, pos, h = row[order], pos[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(row)]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], pos[at], pos[last], h[at]


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in ``known`` (ascending)."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _row_anchors(lane: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last position and hash of each row's distinct anchors."""
    period, cover = cover_for(window)
    width = window - period + 1
    inside = np.zeros(period, bool)
    inside[list(cover)] = True
    n = np.diff(first)
    rows = np.flatnonzero(n >= window)
    count = n[rows] - width + 1
    row = np.repeat(rows, count)
    pos = flat_ranges(np.zeros(len(rows), np.int64), count)
    take = inside[pos % period]
    row, pos = row[take], pos[take]
    hashes = run_hashes(lane, width)
    return _once_a_row(row, pos, hashes[first[row] + pos] if len(row) else NONE)


def _covered(row: np.ndarray, pos: np.ndarray, last: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Word numbers where windows begin that hold one of the anchors at pos to last."""
    n, period = np.diff(first), cover_for(window)[0]
    lo = np.maximum(pos - period + 1, 0)
    hi = np.minimum(last, n[row] - window) + 1
    good = lo < hi
    mark = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(mark, first[row[good]] + lo[good], 1)
    np.add.at(mark, first[row[good]] + hi[good], -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _digests(block, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the words of the window at each word number."""
    length = ends - starts + 1
    edge = np.concatenate([[0], np.cumsum(length)])
    joined = np.append(block.data, np.uint8(32))[flat_ranges(starts, length)]
    joined[edge[1:] - 1] = 32
    raw = memoryview(joined.tobytes())
    both = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edge[at].tolist(), (edge[at + window] - 1).tolist(), strict=True))
    h = np.frombuffer(both, U).reshape(-1, 2)
    return h[:, 0], h[:, 1]


def _ids(block) -> np.ndarray:
    return block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(window: int, frequent: np.ndarray = NONE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            starts, ends, first = block.words()
            lane = word_names(block.data, starts, ends)[0]
            row, pos, last, h = _row_anchors(lane, first, window)
            if not len(row):
                continue
            if len(frequent):
                rare = ~_among(h, frequent)
                row, pos, last, h = row[rare], pos[rare], last[rare], h[rare]
            yield pa.RecordBatch.from_arrays([as_long(h), pa.array(_ids(block)[row]), pa.array(pos.astype(np.int32)), pa.array(last.astype(np.int32))], ["h", "doc_id", "pos", "last"])
        give_back()

    return run


def _frequent_windows(window: int, anchors: np.ndarray):
    """Hash of each row's distinct windows around frequent anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            starts, ends, first = block.words()
            lane = word_names(block.data, starts, ends)[0]
            row, pos, last, h = _row_anchors(lane, first, window)
            own = _among(h, anchors)
            at = _covered(row[own], pos[own], last[own], first, window)
            if len(at):
                row = np.searchsorted(first, at, "right") - 1
                _, _, _, h = _once_a_row(row, at, run_hashes(lane, window)[at])
                yield pa.RecordBatch.from_arrays([as_long(h)], ["h"])
        give_back()

    return run


def _owners(window: int, frequent: np.ndarray):
    """For windows among the frequent ones the smallest doc_id of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {}
        for block in blocks(batches):
            starts, ends, first = block.words()
            lane = word_names(block.data, starts, ends)[0]
            n = np.diff(first)
            rows = np.flatnonzero(n >= window)
            at = flat_ranges(first[:-1][rows], n[rows] - window + 1)
            if not len(at):
                continue
            at = at[_among(run_hashes(lane, window)[at], frequent)]
            if len(at):
                h1, h2 = _digests(block, starts, ends, at, window)
                doc = _ids(block)[np.searchsorted(first, at, "right") - 1]
                for x, y, d in zip(h1.tolist(), h2.tolist(), doc.tolist(), strict=True):
                    least[x, y] = min(least.get((x, y), d), d)
        if least:
            h = np.array(list(least), U)
            yield pa.RecordBatch.from_arrays([as_long(h[:, 0].copy()), as_long(h[:, 1].copy()), pa.array(list(least.values()), pa.int64())], ["h1", "h2", "owner"])
        give_back()

    return run


def _lists(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Flat values, row of each value, of a list column without nulls inside."""
    size = np.nan_to_num(np.array(col.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    return col.flatten(), np.repeat(np.arange(len(col)), size), size


def _windows(window: int, anchors: np.ndarray = NONE, owners: dict[tuple[int, int], int] | None = None):
    """Windows around shared anchors.  Of those in ``owners`` only the repeats are sent, with their
    owner and spread by their place."""
    owners = owners or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            starts, ends, first = block.words()
            n = np.diff(first)
            span, row, _ = _lists(block.column("pos"))
            pos, last = (span.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            ok = (n[row] >= window) & (pos < n[row])
            pos, last, row = pos[ok], last[ok], row[ok]
            if len(anchors):
                lane = word_names(block.data, starts, ends)[0]
                row2, pos2, last2, h = _row_anchors(lane, first, window)
                own = _among(h, anchors)
                row, pos, last = (np.concatenate(x) for x in ((row, row2[own]), (pos, pos2[own]), (last, last2[own])))
            at = _covered(row, pos, last, first, window)
            if not len(at):
                continue
            h1, h2 = _digests(block, starts, ends, at, window)
            # a window that a row repeats is sent once, with all its starts
            row = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((at, h2, h1, row))
            at, h1, h2, row = at[order], h1[order], h2[order], row[order]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            start = (at - first[row]).astype(np.int32)
            more = np.full(len(new), None, object)
            size = np.diff(np.append(new, len(at)))
            for i in np.flatnonzero(size > 1):
                more[i] = start[new[i] + 1 : new[i] + size[i]].tobytes()
            row, h1, h2, start = row[new], h1[new], h2[new], start[new]
            ids = _ids(block)[row]
            tkey = block.column("tkey").to_numpy(zero_copy_only=False)[row].astype(np.int32)
            owner = [None] * len(new)
            if owners:
                owner = [owners.get(x) for x in zip(h1.tolist(), h2.tolist(), strict=True)]
                known = np.array([x is not None for x in owner])
                keep = ~known | (ids > np.array([0 if x is None else x for x in owner]))
                # any key spreads these: their place in the table does
                h1 = np.where(known, ids.astype(U) * U(0x9E3779B97F4A7C15) + start.astype(U), h1)
                h1, h2, ids, tkey, start, more = (x[keep] for x in (h1, h2, ids, tkey, start, more))
                owner = [x for x, k in zip(owner, keep.tolist(), strict=True) if k]
            yield pa.RecordBatch.from_arrays(
                [as_long(h1.copy()), as_long(h2.copy()), pa.array(ids), pa.array(tkey), pa.array(start), pa.array(more, pa.binary()), pa.array(owner, pa.int64())],
                ["h1", "h2", "doc_id", "tkey", "start", "more", "known"],
            )
        give_back()

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            starts, ends, first = block.words()
            n = np.diff(first)
            gone, row, _ = _lists(block.column("gone"))
            mark = np.zeros(len(starts) + window + 1, np.int32)
            if len(row):
                tkey = block.column("tkey").to_numpy(zero_copy_only=False)
                own = gone.field("tkey").to_numpy() == tkey[row]
                at = [first[row[own]] + gone.field("start").to_numpy().astype(np.int64)[own]]
                more = gone.field("more")
                for i in np.flatnonzero(own & np.array(more.is_valid())).tolist():
                    at.append(first[row[i]] + np.frombuffer(more[i].as_py(), np.int32).astype(np.int64))
                at = np.unique(np.concatenate(at))
                mark[at] += 1
                mark[at + window] -= 1
            twin, row, _ = _lists(block.column("copies"))
            if len(row):
                for r in np.unique(row[twin.to_numpy() == block.column("tkey").to_numpy(zero_copy_only=False)[row]]):
                    if n[r] >= window:
                        mark[first[r]] += 1
                        mark[first[r + 1]] -= 1
            keep = np.cumsum(mark)[: len(starts)] == 0
            kept_before = np.concatenate([[0], np.cumsum(keep)])
            left = kept_before[first[1:]] - kept_before[first[:-1]]
            lengths = (ends - starts)[keep] + 1
            out = np.append(block.data, np.uint8(32))[flat_ranges(starts[keep], lengths)]
            edge = np.concatenate([[0], np.cumsum(lengths)])
            out[edge[1:] - 1] = 32
            # a row's text ends before its last separator
            row_edge = edge[kept_before[first]]
            drop = row_edge[1:][left > 0] - 1
            solid = np.ones(len(out), bool)
            solid[drop] = False
            offsets = row_edge - np.concatenate([[0], np.cumsum(left > 0)])
            text = pa.Array.from_buffers(pa.string(), block.rows, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out[solid].tobytes())])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n), pa.array(n - left), text], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _frequent(known: DataFrame, copies: DataFrame, window: int, n_rows: int) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """Hashes of anchors, and owners of windows, that one in FREQUENT documents of a sample holds.

    Both are bounded by the sample of about LOOKED_AT documents; whole copies of an earlier document are left out."""
    looked = min(n_rows, LOOKED_AT)
    least = max(AT_LEAST, looked // FREQUENT)
    near = (F.xxhash64("doc_id", F.lit(31)).cast("double") / 2.0**64 + 0.5) * n_rows < LOOKED_AT
    sample = known.select("doc_id", "text").filter(near).join(copies.select("doc_id").filter(near), "doc_id", "left_anti")
    often = lambda hashes: np.sort(hashes.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("h").toArrow().column("h").to_numpy().view(U))
    anchors = often(sample.mapInArrow(_anchors(window), "h long, doc_id long, pos int, last int").select("h"))
    if not len(anchors):
        return anchors, {}
    windows = often(sample.mapInArrow(_frequent_windows(window, anchors), "h long"))
    if not len(windows):
        return anchors, {}
    rows = known.select("doc_id", "text").mapInArrow(_owners(window, windows), "h1 long, h2 long, owner long").groupBy("h1", "h2").agg(F.min("owner").alias("owner")).toArrow()
    h1, h2 = (rows.column(c).to_numpy().view(U).tolist() for c in ("h1", "h2"))
    return anchors, dict(zip(zip(h1, h2, strict=True), rows.column("owner").to_pylist(), strict=True))


def remove_repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the input.
    The document with the smallest doc_id keeps the passage.

    Null text: no words, empty kept_text.  Null doc_id: the row neither removes
    nor loses words.  Rows that repeat a doc_id don't remove from each other.
    Texts of fewer than ``window`` words stay whole.  Other columns are ignored;
    an empty table gives an empty result."""
    # no alias where none is needed: the two uses of the dealt table must be the same plan for their exchange to be shared
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tkey", F.hash("text"))
    known = docs.filter("doc_id is not null")
    # whole copies are told by one hash a document; they need no windows of their own
    whole = materialize(known.select("doc_id", "tkey", F.sha2(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), 256).alias("m")), "whole")
    n_rows = whole.count()
    lowest = whole.groupBy("m").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner <> last").select("m", "owner")
    late = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))
    copies = join_keys(whole, lowest, "m").withColumn("late", late).groupBy("doc_id").agg(F.collect_set(F.when(F.col("late"), F.col("tkey"))).alias("copies"), F.count("*").alias("n"))
    copies = materialize(copies.filter("size(copies) > 0"), "copies")
    texts = whole.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    only = copies.join(texts, "doc_id").filter("n = n_rows and n = size(copies)").select("doc_id")
    frequent, owners = _frequent(known, copies, window, n_rows)
    # the same columns of known meet three joins on doc_id, so that one exchange of the texts serves anchors, windows and the cut
    alone = known.join(only, "doc_id", "left_anti")
    anchors = alone.mapInArrow(_anchors(window, frequent), "h long, doc_id long, pos int, last int")
    same = Window.partitionBy("h")
    shared = anchors.withColumns({"lo": F.min("doc_id").over(same), "hi": F.max("doc_id").over(same)}).filter("lo <> hi")
    places = shared.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "last")).alias("pos"))
    placed = alone.join(places, "doc_id", "left" if len(frequent) else "inner")
    windows = placed.select("doc_id", "text", "tkey", "pos").mapInArrow(_windows(window, frequent, owners), "h1 long, h2 long, doc_id long, tkey int, start int, more binary, known long")
    found = windows.withColumn("owner", F.coalesce("known", F.min("doc_id").over(Window.partitionBy("h1", "h2")))).filter("doc_id > owner")
    gone = found.groupBy("doc_id").agg(F.collect_list(F.struct("tkey", "start", "more")).alias("gone"))
    marked = known.join(gone, "doc_id", "left").join(copies.select("doc_id", "copies"), "doc_id", "left").select("doc_id", "text", "tkey", "gone", "copies")
    nameless = docs.filter("doc_id is null").select("doc_id", "text", "tkey", F.lit(None).cast(marked.schema["gone"].dataType).alias("gone"), F.lit(None).cast("array<int>").alias("copies"))
    return marked.unionByName(nameless).mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")

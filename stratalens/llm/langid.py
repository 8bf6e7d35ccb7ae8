"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed
length, each filter is max-pooled over the window, and a softmax names the
language.  Applied, a convolution is a sum of table rows: the response of a
filter to each pair of bytes is tabulated once, so no matrix product remains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lowest_by_hash, materialize
from ._text import blocks, flat_ranges

WINDOW = 256
WIDTHS = (2, 3, 4)


@dataclass
class ByteCnn:
    labels: list[str]
    embed: np.ndarray  # (256, d); row 0 pads and is zero
    filters: list[np.ndarray]  # for each width (w, d, f)
    bias: list[np.ndarray]
    out: np.ndarray  # (len(WIDTHS) * f, labels)
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the response tables whose rows add up: by byte pair, then by a single byte for odd widths."""
        made = []
        for w, flt, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            single = [self.embed @ flt[j] for j in range(w)]
            own = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in range(0, w - 1, 2)]
            if w % 2:
                own.append(single[-1].astype(np.float32))
            own[0] = own[0] + bias.astype(np.float32)
            made.append(own)
        return made

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]], step: int = 48) -> np.ndarray:
        """Softmax of each window (rows of WINDOW bytes, zero-padded)."""
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for lo in range(0, len(windows), step):
            x = windows[lo : lo + step].astype(np.int32)
            pair = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for w, own in zip(WIDTHS, tables, strict=True):
                span = WINDOW - w + 1
                total = None
                for i, table in enumerate(own):
                    index = pair[:, 2 * i : 2 * i + span] if len(table) == 65536 else x[:, w - 1 : w - 1 + span]
                    part = np.take(table, index, axis=0)
                    total = part if total is None else np.add(total, part, out=total)
                pooled.append(total.max(1))
            h = np.maximum(np.concatenate(pooled, 1), 0)
            z = h @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[lo : lo + step] = z / z.sum(1, keepdims=True)
        return out


def train(texts: list[bytes], labels: list[str], dims: int = 8, filters: int = 16, epochs: int = 12, steps: int = 400, batch: int = 64, seed: int = 7) -> ByteCnn:
    """Adam on cross-entropy for ``epochs``, and ``steps`` at least; each text gives one window, randomly shortened so that short texts are known too."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    x = np.zeros((len(texts), WINDOW), np.int64)
    for i, t in enumerate(texts):
        own = np.frombuffer(t[:WINDOW], np.uint8)
        x[i, : len(own)] = own
    p = {"e": rng.normal(0, 0.5, (256, dims)), "o": rng.normal(0, 0.1, (filters * len(WIDTHS), len(names))), "ob": np.zeros(len(names))}
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * dims), (w, dims, filters))
        p[f"b{w}"] = np.zeros(filters)
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(max(epochs, -(-steps // -(-len(x) // batch)))):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            take = order[lo : lo + batch]
            xb, yb = x[take].copy(), y[take]
            short = rng.random(len(xb)) < 0.5
            length = np.where(short, rng.integers(6, WINDOW, len(xb)), WINDOW)
            xb[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
            p["e"][0] = 0
            emb = p["e"][xb]
            pooled, kept = [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                cols = np.concatenate([emb[:, j : j + span] for j in range(w)], 2)
                act = cols.reshape(-1, w * dims) @ p[f"f{w}"].reshape(w * dims, filters)
                act = act.reshape(len(xb), span, filters) + p[f"b{w}"]
                at = act.argmax(1)
                pooled.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
                kept.append((cols, at))
            raw = np.concatenate(pooled, 1)
            h = np.maximum(raw, 0)
            z = h @ p["o"] + p["ob"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(yb)), yb] -= 1
            z /= len(yb)
            g = {"o": h.T @ z + 1e-4 * p["o"], "ob": z.sum(0), "e": np.zeros_like(p["e"])}
            back = (z @ p["o"].T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                cols, at = kept[i]
                d = back[:, i * filters : (i + 1) * filters]
                won = cols[np.arange(len(xb))[:, None], at]  # (batch, filters, w * dims)
                g[f"f{w}"] = np.einsum("bf,bfk->kf", d, won).reshape(w, dims, filters)
                g[f"b{w}"] = d.sum(0)
                for j in range(w):
                    np.add.at(g["e"], np.take_along_axis(xb, at + j, 1), d[:, :, None] * p[f"f{w}"][j].T[None])
            t += 1
            for k, grad in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                p[k] -= 5e-3 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    p["e"][0] = 0
    return ByteCnn(names, p["e"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"].astype(np.float32), p["ob"].astype(np.float32))


def labelled_windows(docs: DataFrame, per_label: int = 1200, most: int = 60_000) -> tuple[list[bytes], list[str]]:
    """A bounded sample for training: of every lang at most ``per_label`` rows by
    a hash of doc_id, fewer where there are so many languages that it would be over ``most`` rows
    in all; from each row a stretch of WINDOW characters at a hashed place.  With more than ``most`` languages,
    one row each of the ``most`` most frequent."""
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1
    spoken = docs.filter("lang is not null and length(text) > 0")
    counts = materialize(spoken.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    number = counts.count()
    if number > most:
        counts = materialize(counts.orderBy(F.desc("n"), "lang").limit(most), "languages")
    per_label = max(1, min(per_label, most // max(number, 1)))
    pieces = spoken.select("doc_id", "lang", F.substring("text", start.cast("int"), F.lit(WINDOW)).alias("piece"))
    rows = lowest_by_hash(pieces, "lang", counts, per_label, 2).orderBy("lang", "rank").select("lang", "piece").collect()
    return [r.piece.encode() for r in rows], [r.lang for r in rows]


def _predict(model: ByteCnn | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for block in blocks(batches):
            size = np.diff(block.offsets)
            spoken = np.array(block.column("spoken").to_pylist(), dtype=bool) if block.rows else np.zeros(0, bool)
            use = np.flatnonzero(spoken & (size > 0)) if model else np.zeros(0, np.int64)
            lang, score = np.full(block.rows, "und", object), np.zeros(block.rows)
            if len(use):
                count = -(-size[use] // WINDOW)
                row = np.repeat(np.arange(len(use)), count)
                begin = (flat_ranges(np.zeros(len(use), np.int64), count)) * WINDOW + block.offsets[:-1][use][row]
                length = np.minimum(block.offsets[1:][use][row] - begin, WINDOW)
                windows = np.zeros((len(row), WINDOW), np.uint8)
                windows.ravel()[flat_ranges(np.arange(len(row)) * WINDOW, length)] = block.data[flat_ranges(begin, length)]
                p = model.probabilities(windows, tables).astype(float) * length[:, None]
                doc = np.add.reduceat(p, np.cumsum(count) - count, axis=0) / size[use][:, None]
                best = doc.argmax(1)
                lang[use] = np.array(model.labels, object)[best]
                score[use] = np.clip(doc[np.arange(len(use)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred, score of every document from all windows of its text.

    Windows of WINDOW bytes tile the text; their softmax outputs are averaged by
    length.  Null text or text without a letter: ``und`` with score 0, as is all
    with no model (nothing to learn from).  Only text is an input; other columns
    are ignored, repeated rows get equal results, an empty table gives none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("spoken"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def fit(docs: DataFrame, per_label: int = 1200, most: int = 60_000) -> ByteCnn | None:
    """Trains on at most ``per_label`` labelled rows of each lang and ``most`` in all of docs (doc_id, text, lang); None if there are none."""
    texts, labels = labelled_windows(docs, per_label, most)
    return train(texts, labels) if texts else None

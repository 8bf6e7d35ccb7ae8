"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, lower-cased (A-Z), described by hashed features: the
word, its first bytes and its last bytes.  Documents carry labels, tokens don't:
a token of a toxic document counts as toxic if one of its features is found
almost only in toxic documents of the sample.  The field (two states) is trained
on these labelled tokens by maximum conditional likelihood; forward-backward
marginals give offending spans and, through a small logistic calibration, the
score of the document.  Chains are worked on in pieces of PIECE tokens; messages are
carried over their borders, so that marginals are those of the document's whole
chain.  Training takes the pieces for chains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lowest_by_hash, materialize
from ._text import LOWER, U, _P1, _prefix, blocks, byte_table, flat_ranges, give_back, mix, words_of

BITS, PIECE = 18, 64
#: (from the start?, bytes); 0 bytes: the whole word
FEATURES = ((True, 0), (True, 4), (True, 5), (True, 6), (True, 8), (False, 5))
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True
IS_LETTER[128:] = True
_TABLE = byte_table(6)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends, each row's first token, and (tokens, features) buckets."""
    starts, ends, first = words_of(IS_LETTER[data], offsets)
    prefix, down = _prefix(_TABLE[LOWER[data]], _P1)
    feats = np.empty((len(starts), len(FEATURES)), np.int32)
    for i, (head, size) in enumerate(FEATURES):
        s, e = starts, ends
        if size:
            s, e = (starts, np.minimum(ends, starts + size)) if head else (np.maximum(starts, ends - size), ends)
        h = mix((prefix[e] - prefix[s]) * down[s] + U((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        feats[:, i] = (h >> U(64 - BITS)).astype(np.int32)
    return starts, ends, first, feats


def _pieces(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grid (PIECE, pieces) of token numbers, which cells hold one, each piece's place in its
    document and the column of the piece after it (-1: none)."""
    n = np.diff(first)
    count = -(-n // PIECE)
    row = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * PIECE
    length = np.minimum(PIECE, first[1:][row] - begin)
    order = np.argsort(-length, kind="stable")
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    place = flat_ranges(np.zeros(len(n), np.int64), count)
    after = np.where(place + 1 < np.repeat(count, count), np.append(column[1:], 0)[: len(order)], -1)
    begin, length = begin[order], length[order]
    t = np.arange(PIECE, dtype=np.int32)[:, None]
    return begin[None, :].astype(np.int32) + t, t < length[None, :], place[order], after[order]


def _carry(x: np.ndarray, to1: tuple[float, float], to0: tuple[float, float]) -> np.ndarray:
    """log((e^(x+a)+e^b)/(e^(x+c)+e^d))."""
    return np.logaddexp(x + to1[0], to1[1]) - np.logaddexp(x + to0[0], to0[1])


def forward_backward(e: np.ndarray, held: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds messages of a two-state chain down axis 0: f includes the cell's own e, b doesn't; f + b is the marginal's logit.

    before: f of the token before each column (nan: the chain begins); behind: b at each column's last token."""
    f, b = np.zeros_like(e), np.zeros_like(e)
    width = held.sum(1)
    f[0] = e[0]
    if before is not None:
        inside = ~np.isnan(before)
        f[0, inside] += _carry(before[inside], (trans[1, 1], trans[0, 1]), (trans[1, 0], trans[0, 0]))
    for t in range(1, len(e)):
        w = width[t]  # pieces are sorted by length
        if not w:
            break
        f[t, :w] = e[t, :w] + _carry(f[t - 1, :w], (trans[1, 1], trans[0, 1]), (trans[1, 0], trans[0, 0]))
    if behind is not None:
        last = held.sum(0) - 1
        b[last, np.arange(e.shape[1])] = behind
    for t in range(len(e) - 2, -1, -1):
        w = width[t + 1]
        if w:
            b[t, :w] = _carry(e[t + 1, :w] + b[t + 1, :w], (trans[1, 1], trans[1, 0]), (trans[0, 1], trans[0, 0]))
    return f, b


def border_messages(e: np.ndarray, held: np.ndarray, trans: np.ndarray, place: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """before and behind of forward_backward for pieces of longer chains: each piece is
    summed up in its 2 x 2 transfer (from the state before it to its last token's), and
    those are chained, one place in the document after the other."""
    before, behind = np.full(e.shape[1], np.nan), np.zeros(e.shape[1])
    linked = np.flatnonzero((place > 0) | (after >= 0))
    if not len(linked):
        return before, behind
    x, size = e[:, linked], held[:, linked].sum(0)
    # m[s][z]: log of the sum over paths from state s before the piece to state z at its last token
    m = [[np.full(len(linked), trans[s, 0]), trans[s, 1] + x[0]] for s in (0, 1)]
    for t in range(1, len(x)):
        w = int((size > t).sum())
        if not w:
            break
        for own in m:
            zero = np.logaddexp(own[0][:w] + trans[0, 0], own[1][:w] + trans[1, 0])
            one = x[t, :w] + np.logaddexp(own[0][:w] + trans[0, 1], own[1][:w] + trans[1, 1])
            own[0][:w], own[1][:w] = zero, one
    full = np.zeros((4, e.shape[1]))
    full[:, linked] = m[0][0], m[0][1], m[1][0], m[1][1]
    by_place = np.argsort(place, kind="stable")
    edge = np.searchsorted(place[by_place], np.arange(place.max() + 2))
    first = by_place[edge[0] : edge[1]]
    f, _ = forward_backward(e[:, first], held[:, first], trans)
    now = np.zeros(e.shape[1])  # f at each piece's last token
    now[first] = f[held[:, first].sum(0) - 1, np.arange(len(first))]
    for p in range(int(place.max())):
        own = by_place[edge[p] : edge[p + 1]]
        own = own[after[own] >= 0]
        then = after[own]
        before[then] = now[own]
        now[then] = _carry(now[own], (full[3, then], full[1, then]), (full[2, then], full[0, then]))
    for p in range(int(place.max()) - 1, -1, -1):
        own = by_place[edge[p] : edge[p + 1]]
        own = own[after[own] >= 0]
        then = after[own]
        behind[own] = _carry(behind[then], (full[3, then], full[2, then]), (full[1, then], full[0, then]))
    return before, behind


@dataclass
class ToxicField:
    weights: np.ndarray  # 2**BITS
    bias: float
    trans: np.ndarray  # (2, 2), from state to state
    calibration: np.ndarray  # for 1, the two top logits, log1p(expected toxic tokens)

    def marginals(self, first: np.ndarray, feats: np.ndarray) -> np.ndarray:
        """Logit of each token's probability of being toxic."""
        out = np.zeros(len(feats))
        if not len(feats):
            return out
        e = np.full(len(feats), self.bias)
        for i in range(feats.shape[1]):
            e += self.weights[feats[:, i]]
        at, held, place, after = _pieces(first)
        grid = np.where(held, e[np.minimum(at, len(e) - 1)], 0.0)
        f, b = forward_backward(grid, held, self.trans, *border_messages(grid, held, self.trans, place, after))
        out[at[held]] = (f + b)[held]
        return out


def summary(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document 1, its two top logits (bounded), log1p of expected toxic tokens."""
    x = np.zeros((len(first) - 1, 4))
    x[:, 0] = 1
    x[:, 1:3] = -8
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        size = np.diff(first)[some]
        top = np.maximum.reduceat(logits, first[:-1][some])
        x[some, 1] = np.clip(top, -8, 8)
        below = np.where(logits < np.repeat(top, size), logits, -8)
        twice = np.add.reduceat((logits >= np.repeat(top, size)).astype(int), first[:-1][some]) > 1
        x[some, 2] = np.clip(np.where(twice, top, np.maximum.reduceat(below, first[:-1][some])), -8, 8)
        x[some, 3] = np.log1p(np.add.reduceat(1 / (1 + np.exp(-np.clip(logits, -30, 30))), first[:-1][some]))
    return x


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def distinct_documents(doc: np.ndarray, words: np.ndarray, n: int, keep: int = 16, shared: int = 8) -> np.ndarray:
    """Which of n documents aren't copies, exact or near, of one before: of the
    ``keep`` smallest hashes of three words in a row a copy shares at least ``shared``."""
    rows = words.astype(U)
    rows = mix(rows + np.append(rows[1:], U(0)) * U(1 << 20) + np.append(rows[2:], np.zeros(min(2, len(rows)), U)) * U(1 << 40))
    pair = np.unique(doc.astype(np.int64) << 32 | (rows >> U(33)).astype(np.int64))
    own, first = pair & 0xFFFFFFFF, np.searchsorted(pair >> 32, np.arange(n + 1))
    holders: dict[int, list[int]] = {}
    fresh = np.ones(n, bool)
    for d in range(n):
        least = own[first[d] : min(first[d] + keep, first[d + 1])].tolist()
        met: dict[int, int] = {}
        for x in least:
            for other in holders.get(x, ()):
                met[other] = met.get(other, 0) + 1
        fresh[d] = max(met.values(), default=0) < max(1, min(shared, len(least)))
        if fresh[d]:
            for x in least:
                holders.setdefault(x, []).append(d)
    return fresh


def background(words: np.ndarray, doc: np.ndarray, toxic: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For each document the toxic share of the other documents that share its words,
    each counted once for each word in common, so that a language is held against
    itself; 1, which proves nothing, where there are none."""
    counted = fresh[doc]
    pair = np.unique(doc[counted].astype(np.int64) << 32 | words[counted])
    own, holder = pair & 0xFFFFFFFF, pair >> 32
    n = np.bincount(own, minlength=1 << BITS)
    a = np.bincount(own[toxic[holder]], minlength=1 << BITS)
    others = np.bincount(holder, n[own] - 1, minlength=len(toxic))
    bad = np.bincount(holder, a[own] - toxic[holder], minlength=len(toxic))
    return np.where(others > 0, bad / np.maximum(others, 1), 1.0)


def token_labels(feats: np.ndarray, doc: np.ndarray, toxic: np.ndarray, fresh: np.ndarray, purity: float = 0.75, false: float = 0.01) -> np.ndarray:
    """1 for tokens of toxic documents with a feature that, with classes weighed
    alike, is found in toxic documents ``purity`` of the time, and in more of them
    than chance allows.  Copies count once.

    Chance is the background of the documents that hold the feature.  The tail
    is Chernoff's bound of the binomial; Benjamini and Hochberg's procedure over all
    features of a kind keeps the share of ``false`` findings, so the bar follows the
    evidence and not the sample's size or a language's share of it."""
    rate = background(feats[:, 0], doc, toxic, fresh)
    marked = np.zeros(len(doc), bool)
    counted = fresh[doc]
    for i in range(feats.shape[1]):
        pair = np.unique(doc[counted].astype(np.int64) << 32 | feats[counted, i])
        own, holder = (pair & 0xFFFFFFFF).astype(np.int64), pair >> 32
        n = np.bincount(own, minlength=1 << BITS)
        a = np.bincount(own[toxic[holder]], minlength=1 << BITS)
        found = np.flatnonzero(n)
        n, a = n[found], a[found]
        chance = np.clip(np.bincount(own, rate[holder], minlength=1 << BITS)[found] / n, 1e-6, 1 - 1e-6)
        x = a / n
        tail = -n * (x * np.log(np.maximum(x, 1e-12) / chance) + (1 - x) * np.log(np.maximum(1 - x, 1e-12) / (1 - chance)))
        tail = np.where(x > chance, tail, 0.0)
        ranked = np.sort(tail)
        passing = np.flatnonzero(ranked <= np.log(false * np.arange(1, len(found) + 1) / max(len(found), 1)))
        if not len(passing):
            continue
        pure = np.zeros(1 << BITS, bool)
        pure[found] = (tail <= ranked[passing[-1]]) & (a >= purity * (a + (n - a) * chance / (1 - chance)))
        marked |= pure[feats[:, i]]
    return (marked & toxic[doc]).astype(np.float64)


def train(texts: list[bytes], toxic: list[int], whole: list[bool] | None = None, epochs: int = 6, steps: int = 150, rate: float = 0.3, decay: float = 1e-6, seed: int = 5) -> ToxicField:
    """Adagrad on the chains' conditional log-likelihood (``epochs``, and ``steps`` at least), then the
    calibration, on texts that are ``whole`` (their label may rest on what was cut off the others)."""
    y_doc, parts, counts = np.array(toxic, bool), [], [np.zeros(1, np.int64)]
    for lo in range(0, len(texts), 256):
        some = texts[lo : lo + 256]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
        _, _, first, feats = tokens(np.frombuffer(b"".join(some), np.uint8), offsets)
        parts.append(feats)
        counts.append(first[1:] + counts[-1][-1])
    feats, first = np.concatenate(parts), np.concatenate(counts)
    del parts, counts
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    fresh = distinct_documents(doc, feats[:, 0], len(texts))
    y = token_labels(feats, doc, y_doc, fresh)
    w, acc = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    bias, trans = -3.0, np.zeros((2, 2))
    g2b, g2t = 1e-2, np.full((2, 2), 1e-2)
    rng = np.random.default_rng(seed)
    at, held, _, _ = _pieces(first)
    epochs = max(epochs, -(-steps // max(1, -(-at.shape[1] // 2048))))
    for _ in range(epochs if len(feats) else 0):
        order = rng.permutation(at.shape[1])
        for lo in range(0, len(order), 2048):
            own = np.sort(order[lo : lo + 2048])
            a, h = at[:, own], held[:, own]
            e = np.where(h, w[feats[np.minimum(a, len(feats) - 1)]].sum(2) + bias, 0.0)
            f, b = forward_backward(e, h, trans)
            p = 1 / (1 + np.exp(-np.clip(f + b, -30, 30)))
            label = np.where(h, y[np.minimum(a, len(y) - 1)], 0)
            d = np.where(h, p - label, 0)[h]
            n = max(h.sum(), 1) / 50
            grad = np.bincount(feats[a[h]].ravel(), np.repeat(d, feats.shape[1]), minlength=1 << BITS) / n
            touched = grad != 0
            grad[touched] += decay * w[touched]
            acc[touched] += grad[touched] ** 2
            w[touched] -= rate * grad[touched] / np.sqrt(acc[touched])
            gb = d.sum() / n
            g2b += gb * gb
            bias -= rate * gb / np.sqrt(g2b)
            both = h[1:]
            right = e[1:] + b[1:]
            logs = np.stack([np.full(right.shape, trans[0, 0]), trans[0, 1] + right, trans[1, 0] + f[:-1], trans[1, 1] + f[:-1] + right])
            logs = np.exp(logs - logs.max(0))
            logs /= logs.sum(0)
            gt = np.array([(logs[k] * both).sum() for k in range(4)]).reshape(2, 2)
            l0, l1 = label[:-1], label[1:]
            gt -= np.array([[((1 - l0) * (1 - l1) * both).sum(), ((1 - l0) * l1 * both).sum()], [(l0 * (1 - l1) * both).sum(), (l0 * l1 * both).sum()]])
            gt = gt / n + decay * trans
            g2t += gt * gt
            trans = trans - rate * gt / np.sqrt(g2t)
    field = ToxicField(w.astype(np.float32), float(bias), trans, np.zeros(4))
    uncut = fresh & np.array(whole, bool) if whole is not None and len({t for t, w, f in zip(toxic, whole, fresh, strict=True) if w and f}) > 1 else fresh
    field.calibration = _logistic(summary(field.marginals(first, feats), first)[uncut], y_doc[uncut].astype(float))
    return field


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 12000) -> ToxicField | None:
    """Trains on a bounded sample: of each class at most ``per_class`` labelled
    documents by a hash of doc_id, of each at most ``longest`` characters: of a longer text
    a stretch at a hashed place.

    labels: doc_id, toxic (0 or 1; other values and nulls are left out; the
    largest of repeated labels counts).  Of rows that repeat a doc_id one text serves.
    None without both classes."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # what can be sampled: labelled documents with a text, each id once
    usable = docs.filter(F.length("text") > 0).select("doc_id").distinct().join(known, "doc_id").select("doc_id", "toxic")
    usable = materialize(usable, "labelled")
    counts = usable.groupBy("toxic").agg(F.count("*").alias("n"))
    ids = lowest_by_hash(usable, "toxic", counts, per_class, 3).select("doc_id", "toxic")
    size = F.length("text")
    start = (F.pmod(F.xxhash64("doc_id", F.lit(4)), F.greatest(size - longest + 1, F.lit(1))) + 1).cast("int")
    piece = F.struct((size <= longest).alias("whole"), F.substring("text", start, F.lit(longest)).alias("text"))
    rows = docs.filter(size > 0).select("doc_id", piece.alias("p")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("p").alias("p"), F.max("toxic").alias("toxic"))
    rows = rows.select("doc_id", "toxic", "p.whole", "p.text").toArrow().sort_by("doc_id")
    toxic, whole = rows.column("toxic").to_pylist(), rows.column("whole").to_pylist()
    if len(set(toxic)) < 2:
        return None
    texts = [t.as_py().encode() for t in rows.column("text")]
    del rows
    field = train(texts, toxic, whole)
    give_back()
    return field


def _score(field: ToxicField | None, level: float):
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            score, spans = np.zeros(block.rows), [[] for _ in range(block.rows)]
            if field:
                starts, ends, first, feats = tokens(block.data, block.offsets)
                logits = field.marginals(first, feats)
                z = summary(logits, first) @ field.calibration
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                hot = np.flatnonzero(logits >= np.log(level / (1 - level)))
                if len(hot):
                    chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                    rows = np.searchsorted(first, hot, "right") - 1
                    base = chars[block.offsets[:-1]]
                    last = None
                    for t, r in zip(hot.tolist(), rows.tolist(), strict=True):
                        p = float(1 / (1 + np.exp(-logits[t])))
                        end = int(chars[ends[t]] - base[r])
                        if last is not None and spans[r] and last == t - 1:
                            spans[r][-1]["end"] = end
                            spans[r][-1]["marginal"] = max(p, spans[r][-1]["marginal"])
                        else:
                            spans[r].append({"begin": int(chars[starts[t]] - base[r]), "end": end, "marginal": p})
                        last = t
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(score), pa.array(spans, pa.list_(span))], ["doc_id", "score", "spans"])

    return run


def score(docs: DataFrame, field: ToxicField | None, level: float = 0.5) -> DataFrame:
    """doc_id, score, spans (code-point begin and end, exclusive, and top marginal)
    of every document over its whole text.

    Adjacent tokens with a marginal of at least ``level`` form one span.  Null or
    empty text scores as a text without tokens; with no field all scores are 0.
    Only text is an input; other columns are ignored; repeated rows get equal
    results; an empty table gives none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(field, level), "doc_id long, score double, spans array<struct<begin:long,end:long,marginal:double>>")


def keep_below(docs: DataFrame, field: ToxicField | None, threshold: float = 0.7) -> DataFrame:
    """The rows of docs (all columns) whose text scores below ``threshold``; all of them with no field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            own = block.batch.slice(block.lo, block.rows)
            if field:
                _, _, first, feats = tokens(block.data, block.offsets)
                z = summary(field.marginals(first, feats), first) @ field.calibration
                own = own.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))
            yield own
        give_back()

    return docs.mapInArrow(run, docs.schema)

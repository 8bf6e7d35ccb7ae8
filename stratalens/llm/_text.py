"""Vectorised text primitives shared by the Arrow-batched operators.

A string column arrives as one byte buffer plus offsets; most work is done on that
buffer for a whole block of rows at once.  Words are named by 128 bits: eight bytes
at a time go through a mixing that isn't linear (a word of up to eight bytes is its
own name), and runs of words are named by combining halves in the same way, so that
no family of words or of word sequences collides by structure.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_LIBC = ctypes.CDLL(None)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
BLOCK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a copy."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 random odd 64-bit numbers; the hash of a byte before positions count."""
    return mix(np.arange(1, 257, dtype=U) * U(2 * seed + 1)) | U(1)


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up, self.down


_P1 = _Powers(_BASE, _BASE_INV)


def _prefix(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of ``values[i] * B**i`` modulo 2**64 and the powers of 1 / B, for
    hashed features only: some long strings collide under any base."""
    up, down = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], dtype=U, out=out[1:])
    return out, down


_LANES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)), (U(0xC2B2AE3D27D4EB4F), U(0xA0761D6478BD642F))


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit lanes that name each word ``data[s:e]``; either is one-to-one on words of up to eight bytes of one length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(data) + 1,), (1,), writeable=False)
    length = ends - starts
    lanes = [mix(length.astype(U) * c) for _, c in _LANES]
    some, at, left = slice(None), starts, length
    while len(at):
        chunk = eight[at]
        short = left < 8
        chunk[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        for lane, (c, _) in zip(lanes, _LANES, strict=True):
            lane[some] = mix((lane[some] ^ chunk) * c)
        more = np.flatnonzero(left > 8)
        some = more if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
    return lanes


def _combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15)
    x += b * U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word names (runs over the whole block), by doubling."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, size, level = None, 0, 1, words
    while True:
        if k & size:
            part = level[done : done + n]
            out = _combined(part, part) if out is None else _combined(out, part)
            done += size
        if done == k:
            return out
        level = _combined(level[: len(level) - size], level[size:])
        size *= 2


class Block:
    """Rows ``lo:hi`` of a batch with their texts' bytes."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.lo, self.hi = batch, lo, hi
        self.offsets = offsets[lo : hi + 1] - offsets[lo]
        self.data = data[offsets[lo] : offsets[hi]]
        self.rows = hi - lo

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name)).slice(self.lo, self.rows)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, and for each row the index of its first word (one more at the end)."""
        return words_of(~IS_SPACE[self.data], self.offsets)


def words_of(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each row."""
    if not len(solid):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    before = np.empty(len(solid), bool)
    before[0] = False
    before[1:] = solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(solid)]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(solid), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls have no bytes."""
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts batches into blocks of about ``limit`` bytes of text; a longer text is a block of its own."""
    for batch in batches:
        raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield Block(batch, lo, hi, raw, offsets)
            lo = hi


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

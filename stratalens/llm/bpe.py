"""Byte-level BPE encoding and decoding over a distinct-word table.

Texts are split at safe places (before white space that follows a solid
character), where no pre-token of the tokenizer can reach across.  Each stretch
of input (a chunk) lists its distinct words; the lists are dealt out by word
hash, so that every distinct word of the corpus meets in one place and is
encoded once; the ids travel back to the chunks and are joined to the words by
position.  Decoding looks pieces up by id and joins their bytes.

Lists travel packed: one row for each (chunk, slice of the hash range), words as
one compressed blob, ids in the order of the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import IS_SPACE, U, blocks, flat_ranges, give_back, mix

#: Text of one chunk, and text for each slice of the hash range.
CHUNK_BYTES, SLICE_BYTES = 12 << 20, 16 << 20
_PACKED = "chunk string, bucket int, payload binary"
#: Words joined for one call, and texts of one call.
_JOINED, _AT_ONCE = 2000, 8


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob with a small header."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.nbytes, a.dtype.num))], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.int32, np.uint32, np.int64, np.uint64)}


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for size, kind in sizes.tolist():
        out.append(np.frombuffer(raw, np.uint8, size, at).view(_TYPES[kind]))
        at += size
    return out


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at a row's first byte, and at ASCII white space after a
    byte that can't end a white-space character."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = IS_SPACE[data]
    prev = np.empty_like(data)
    prev[0], prev[1:] = 32, data[:-1]
    prev2 = np.empty_like(data)
    prev2[:2], prev2[2:] = 32, data[:-2]
    # U+0085, U+00A0 end in C2 xx; the other white-space characters have 9A, 80 or 81 second to last; 1C-1F count as white space somewhere
    wide = (prev >= 128) & ((prev2 == 0xC2) | (prev2 == 0x9A) | (prev2 == 0x80) | (prev2 == 0x81))
    start = space & ~IS_SPACE[prev] & ~wide & ~((prev >= 0x1C) & (prev <= 0x1F))
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(start)


class _Chunk:
    """Distinct words of up to CHUNK_BYTES of text, most frequent first, and each row's words as numbers.

    Words are told apart by their bytes; a hash only deals them out."""

    def __init__(self):
        self.ids, self.counts, self.numbers, self.bytes, self.known, self.name = [], [], [], 0, {}, blake2b(digest_size=16)

    def add(self, block) -> None:
        data, offsets = block.data, block.offsets
        starts = word_starts(data, offsets)
        raw, known = data.tobytes(), self.known
        begin = starts.tolist()
        own = (known.setdefault(raw[a:b], len(known)) for a, b in zip(begin, [*begin[1:], len(raw)], strict=True))
        self.numbers.append(np.fromiter(own, np.uint32, len(begin)))
        self.counts.append(np.diff(np.searchsorted(starts, offsets)))
        ids = block.column("doc_id")
        self.ids.append((ids.fill_null(0).to_numpy().astype(np.int64), np.array(ids.is_null()).astype(np.uint8)))
        self.name.update(raw + offsets.tobytes())
        self.bytes += len(data)

    def rows(self, place: str, buckets: int, words: bool) -> Iterator[tuple[str, int, bytes]]:
        """(chunk, bucket, payload): each bucket's words, or the one row of the documents.

        The chunk is named by its place and its texts, so that both readings agree or fail."""
        name = f"{place}-{self.name.hexdigest()}"
        number, self.numbers = np.concatenate(self.numbers), []
        order = np.argsort(-np.bincount(number, minlength=len(self.known)), kind="stable")
        dealt = np.fromiter(map(crc32, self.known), np.uint32, len(self.known)).astype(U)
        bucket = (mix(dealt) % U(buckets)).astype(np.int64)[order]
        if words:
            del number
            listed = list(self.known)
            by_bucket = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            for b in range(buckets):
                own = [listed[i] for i in order[by_bucket[edge[b] : edge[b + 1]]].tolist()]
                if own:
                    yield name, b, _pack(np.frombuffer(b"".join(own), np.uint8), np.fromiter(map(len, own), np.int32, len(own)))
        else:
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            planes = rank[number].astype("<u4").view(np.uint8).reshape(-1, 4)
            del number
            ids, null = (np.concatenate([x[i] for x in self.ids]) for i in (0, 1))
            yield name, -1, _pack(ids, null, np.concatenate(self.counts).astype(np.int32), bucket.astype(np.int32), *(np.ascontiguousarray(planes[:, i]) for i in range(4)))


def _split(buckets: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()

        def out():
            for c, b, p in chunk.rows(f"{part}-{number}", buckets, words):
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([b], pa.int32()), pa.array([p], pa.binary())], ["chunk", "bucket", "payload"])

        for block in blocks(batches):
            chunk.add(block)
            if chunk.bytes >= CHUNK_BYTES:
                yield from out()
                number, chunk = number + 1, _Chunk()
        if chunk.ids:
            yield from out()
        chunk = None
        give_back()

    return run


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begins and lengths of the pieces by id: the id-to-piece table, as large as the vocabulary."""
    t = _tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = t.get_vocab(with_added_tokens=True)
    made = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        made[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    length = np.array([len(x) for x in made], np.int64)
    return np.frombuffer(b"".join(made), np.uint8), np.cumsum(length) - length, length


def encode_words(t, piece_bytes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and where each word's begin and how many they are.

    Words that begin with white space and end in a solid character (by the rule of
    word_starts) are handed to the tokenizer many at a time: no pre-token reaches over their borders, and
    the pieces' lengths tell where each word's ids end."""
    safe = [i for i, w in enumerate(words) if w[0] in b" \t\n\x0b\x0c\r" and (0x21 <= w[-1] <= 0x7E or w[-1] >= 0x80 and w[-2] not in (0xC2, 0x9A, 0x80, 0x81))]
    begin, size, flat, done = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)], 0
    groups = [safe[i : i + _JOINED] for i in range(0, len(safe), _JOINED)]
    chosen = np.zeros(len(words), bool)
    chosen[safe] = True
    groups += [[i] for i in np.flatnonzero(~chosen).tolist()]
    for at in range(0, len(groups), _AT_ONCE):
        some = groups[at : at + _AT_ONCE]
        for group, e in zip(some, t.encode_batch_fast([b"".join(words[i] for i in g).decode() for g in some], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.concatenate([[0], np.cumsum(piece_bytes[ids])])
            cut = np.searchsorted(ends, np.concatenate([[0], np.cumsum([len(words[i]) for i in group])]))
            begin[group], size[group] = done + cut[:-1], np.diff(cut)
            flat.append(ids)
            done += len(ids)
    return np.concatenate(flat), begin, size


def _encode(path: str):
    def run(table: pa.Table) -> pa.Table:
        """One slice of the hash range, of all chunks: each distinct word is encoded once."""
        t = _tokenizer(path)
        lists, number = [], {}
        for blob in table.column("payload"):
            raw, length = _unpack(blob.as_py())
            whole, edge = raw.tobytes(), np.concatenate([[0], np.cumsum(length)]).tolist()
            own = (number.setdefault(whole[a:b], len(number)) for a, b in zip(edge, edge[1:], strict=False))
            lists.append(np.fromiter(own, np.int64, len(length)))
        flat, begin, size = encode_words(t, _pieces(path)[2], list(number))
        out = [_pack(flat[flat_ranges(begin[n], size[n])], size[n].astype(np.int32)) for n in lists]
        del number, flat, lists
        give_back()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _join(path: str):
    def whole(docs: pa.Table, table: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = sorted(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True))
        parts = [_unpack(p) for _, p in lists]
        flat = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)
        size = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        if not len(docs) or (docs.column("chunk").to_pylist().count(docs.column("chunk")[0].as_py()) != 1):
            raise RuntimeError("the two readings of the documents differ; write them to a table first")
        for blob in docs.column("payload").to_pylist():
            ids, null, counts, bucket, *planes = _unpack(blob)
            if len(bucket) != len(size):
                raise RuntimeError("the two readings of the documents differ; write them to a table first")
            where = np.empty(len(bucket), np.int64)
            where[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
            place = where[np.ascontiguousarray(np.stack(planes, 1)).view("<u4").ravel()] if len(planes[0]) else np.zeros(0, np.int64)
            edge = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
            lo = 0
            while lo < len(ids):  # about a million ids at a time
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + 150_000, "right")) - 1)
                own = place[edge[lo] : edge[hi]]
                n = size[own]
                got = flat[flat_ranges(begin[own], n)]
                upto = np.concatenate([[0], np.cumsum(n)])[edge[lo : hi + 1] - edge[lo]]
                yield _decoded(path, ids[lo:hi], null[lo:hi], got, upto)
                lo = hi

    return whole


def _decoded(path: str, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    """Rows of result from ids (row i has ``edge[i]:edge[i + 1]``) through the id-to-piece table."""
    raw, begin, length = _pieces(path)
    n = length[ids]
    text = raw[flat_ranges(begin[ids], n)]
    at = np.concatenate([[0], np.cumsum(n)])[edge].astype(np.int32)
    decoded = pa.Array.from_buffers(pa.string(), len(doc_ids), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(text.tobytes())])
    try:
        decoded.validate(full=True)
    except pa.ArrowInvalid:  # bytes that aren't UTF-8, as a tokenizer decodes them
        blob = text.tobytes()
        decoded = pa.array([blob[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)], pa.string())
    binary = pa.Array.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer((edge * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=null.astype(bool)), pa.array(np.diff(edge).astype(np.int64)), binary, decoded], schema=_OUT)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded.

    Ids are those of the tokenizers library with add_special_tokens=False and no
    truncation or padding; decoded is its decode(ids, skip_special_tokens=False).
    The tokenizer must be byte-level BPE without normalizer or prefix space.

    Null or empty text: no ids, empty decoded text.  Null and repeated doc_ids
    pass through; other columns are ignored; an empty table gives none.

    The documents are read twice; a table that doesn't come back in the same
    partitions and order (one that isn't read from files) is an error, not a wrong result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // SLICE_BYTES))
    lists = rows.mapInArrow(_split(buckets, True), _PACKED)
    coded = lists.groupBy("bucket").applyInArrow(_encode(tokenizer_path), _PACKED)
    numbered = rows.mapInArrow(_split(buckets, False), _PACKED)
    whole = _join(tokenizer_path)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(whole(left, right), schema=_OUT)
        give_back()
        return out

    both = numbered.groupBy("chunk").cogroup(coded.groupBy("chunk"))
    return both.applyInArrow(join, "doc_id long, n_tokens long, ids binary, decoded string")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and decoded text of (doc_id, ids) rows; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                blobs = [x or b"" for x in part.column(1).to_pylist()]
                edge = np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]).astype(np.int64)
                ids = part.column(0)
                got = _decoded(tokenizer_path, ids.fill_null(0).to_numpy(), np.array(ids.is_null()).astype(np.uint8), np.frombuffer(b"".join(blobs), "<u4"), edge)
                yield got.select(["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")

"""Near-duplicate detection with SetSketch registers.

Registers are exponentially spaced truncated minima: register i holds
``clip(floor(1 - log_b(x_i)), 0, q + 1)`` where ``x_i`` is the least of
exponentially distributed hashes (rate ``A``) of the set's shingles.  They merge
by element-wise maximum and agree with probability close to the Jaccard
similarity, so groups of registers serve as bands.  Candidates pass a joint
likelihood test on the registers of both sets, then an exact check on the full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._store import drop, join_keys, materialize
from ._text import LOWER, U, Block, as_long, blocks, give_back, mix, run_hashes, word_names
from .components import connected_components

M, ROWS, A, BASE, Q = 128, 4, 20.0, 1.001, 32765
#: Members verified together with a leader; nodes of a block; most ids that are broadcast.
GROUP, BLOCK, BROADCAST_IDS = 500, 256, 500_000
#: Turns of other leaders, and from how many pairs for each row, and in all, one is worth its while: a turn is
#: some tens of jobs, and a core compares about a million pairs in a second.
MOST_TURNS, CROWDED, LEAST_PAIRS = 6, 30, 1_000_000_000
#: Nodes of the sample that looks for large buckets, and the share of it (one in so many) that makes one.
LOOKED_AT, FREQUENT = 20_000, 1_000
_MUL = mix(np.arange(1, M + 1, dtype=U)) | U(1)
_ADD = mix(np.arange(1001, M + 1001, dtype=U))


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct k-word shingles (A-Z lower-cased): two 64-bit lanes, ascending, and
    where each row's begin.  A row of 1 to k-1 words has one."""
    starts, ends, first = block.words()
    words = word_names(LOWER[block.data], starts, ends)
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(block.rows), n)
    pos = first[row] + np.arange(at[-1]) - at[row]
    long = count[row] >= k
    short = np.flatnonzero((count > 0) & (count < k))
    lanes = []
    for own in words:
        out = np.empty(at[-1], U)
        out[long] = run_hashes(own, k)[pos[long]]
        for r in short:
            out[at[r]] = mix(run_hashes(own[first[r] : first[r + 1]], int(count[r])) ^ U(count[r]))[0]
        lanes.append(out)
    h1, h2 = lanes
    for keys in ((h1, row), (h2, h1, row)):  # the second only if a first lane repeats with another second one
        order = np.lexsort(keys)
        a, b, r = h1[order], h2[order], row[order]
        same = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
        if not (same & (b[1:] != b[:-1])).any():
            break
    new = np.append(True, ~same | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new], np.concatenate([[0], np.cumsum(np.bincount(r[new], minlength=block.rows))])


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SetSketch registers of each non-empty row's hashes: (rows, M) int16."""
    full = np.flatnonzero(np.diff(at) > 0)
    least = np.full((len(at) - 1, M), np.iinfo(np.uint64).max, U)
    cut = np.concatenate([at[:-1][full], at[-1:]])
    lo = 0
    while lo < len(full):  # pieces that stay in cache
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + 16384, "right")) - 1)
        own, edges = hashes[cut[lo] : cut[hi]], cut[lo:hi] - cut[lo]
        for i in range(M):
            least[full[lo:hi], i] = np.minimum.reduceat(own * _MUL[i] + _ADD[i], edges)
        lo = hi
    u = least.astype(np.float64) * 2.0**-64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / A
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.clip(k, 0, Q + 1).astype(np.int16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 101) -> tuple[np.ndarray, np.ndarray]:
    """Joint log-likelihood of similarity on a grid up to its bound, for pairs
    with ``more``/``less``/``same`` registers and set sizes na, nb."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    tiny = 1e-12
    a, b = np.maximum(_p(u - v * j), tiny), np.maximum(_p(v - u * j), tiny)
    e = np.maximum(1 - a - b, tiny)
    return j, more[:, None] * np.log(a) + less[:, None] * np.log(b) + same[:, None] * np.log(e)


def plausible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, slack: float = 14.0) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs' registers don't rule out the threshold, and the estimates.

    A pair goes only if sizes alone forbid the threshold, or the best likelihood
    at or above it is e**-slack of the best overall."""
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    j, ll = likelihood(more, less, M - more - less, na.astype(float), nb.astype(float))
    best = ll.max(1)
    high = np.where(j >= threshold - 1e-9, ll, -np.inf).max(1)
    fits = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    return fits & (high >= best - slack), j[np.arange(len(j)), ll.argmax(1)]


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    return total[at[1:]] - total[at[:-1]]


def _sketch_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            own1, own2, at = shingles(block, k)
            regs = registers(own1, at)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(block.rows + 1, dtype=np.int32) * M), pa.array(regs.ravel()))
            h1, h2 = _row_sums(own1, at), _row_sums(own2, at)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(at)), as_long(mix(h1)), as_long(mix(h2)), flat], ["doc_id", "n_shingles", "h1", "h2", "regs"])
        give_back()

    return run


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits that name the set), regs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sketch_batches(k), "doc_id long, n_shingles long, h1 long, h2 long, regs array<smallint>"
    )


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            own1, own2, at = shingles(block, k)
            half = (own2 >> U(32)).astype(np.uint32)
            blobs = [own1[a:b].tobytes() + half[a:b].tobytes() for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(blobs, pa.binary())], ["node", "items"])
        give_back()

    return run


def _regs(part, name: str) -> np.ndarray:
    return part.column(name).combine_chunks().flatten().to_numpy().reshape(-1, M) if isinstance(part, pa.Table) else part.column(part.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, M)


def _filter_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                keep, _ = plausible(_regs(part, "regs_a"), _regs(part, "regs_b"), col("n_a").to_numpy(), col("n_b").to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([col("a"), col("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _likely_stars(stars: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(g, a, b): pairs of a bucket's smallest node and another that the registers don't rule out; g groups by leader and up to GROUP of its members."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    likely = materialize(join_keys(stars, side("a"), "a").join(side("b"), "b").mapInArrow(_filter_batches(threshold), "a long, b long").distinct(), "pairs")
    size = materialize(likely.groupBy("a").agg(F.count("*").alias("n")), "sizes")
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP))
    return join_keys(likely, size, "a", size).select(F.xxhash64("a", salt).alias("g"), "a", "b")


def _likely_within(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of a block (g) in different components that share a first band there."""
        g, node, comp, side, band, n = (table.column(c).to_numpy() for c in ("g", "node", "c", "side", "band", "n_shingles"))
        regs = _regs(table, "regs")
        order = np.argsort(g, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(g[order])) + 1, [len(order)]])
        out = []
        for lo, hi in zip(edge.tolist(), edge.tolist()[1:], strict=False):
            own = order[lo:hi]
            left, right = own[side[own] != 2], own[side[own] != 1]  # 0: a block with itself
            for part in np.array_split(left, -(-len(left) * len(right) // 8192) or 1):
                x, y = (z.ravel() for z in np.meshgrid(part, right, indexing="ij"))
                take = comp[x] != comp[y]
                take &= (node[x] < node[y]) | (side[x] != 0)
                take &= np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9
                x, y = x[take], y[take]
                if not len(x):
                    continue
                ra, rb = regs[x], regs[y]
                same = (ra == rb).reshape(len(x), -1, ROWS).all(2)
                mine = same.argmax(1) == band[x]  # the pair's first common band judges it
                x, y, ra, rb = x[mine], y[mine], ra[mine], rb[mine]
                if len(x):
                    keep, _ = plausible(ra, rb, n[x], n[y], threshold)
                    out.append((g[x[keep]], node[x[keep]], node[y[keep]]))
        got = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"g": got[0], "a": np.minimum(got[1], got[2]), "b": np.maximum(got[1], got[2])})

    return run


def _likely_rest(rest: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(g, a, b): the pairs in different components of a bucket that the registers
    don't rule out.  Large buckets are cut into blocks of BLOCK nodes and each
    pair of blocks is a group; no pairs are made before the registers are compared."""
    size = rest.groupBy("key").agg(F.count("*").alias("n")).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = rest.join(size, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = rows.select("node", "c", "band", F.xxhash64("key", lo, hi).alias("g"), side.cast("int").alias("side"))
    rows = rows.join(nodes.select("node", "n_shingles", "regs"), "node")
    lots = max(16, rest.count() // 10000)
    return rows.groupBy(F.pmod("g", F.lit(lots)).alias("lot")).applyInArrow(_likely_within(threshold), "g long, a long, b long")


def common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two sets of 96-bit names, given as two columns ascending by the first."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if not len(x[0]):
        return 0
    where = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    met = y[0][where] == x[0]
    same = int((met & (y[1][where] == x[1])).sum())
    if same == int(met.sum()) and (x[0][1:] != x[0][:-1]).all():
        return same
    return len(set(zip(*[c.tolist() for c in x], strict=True)) & set(zip(*[c.tolist() for c in y], strict=True)))


def _check(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        """The pairs whose full sets are similar enough."""
        items = []
        for x in sets.column("items"):
            raw = x.as_py()
            n = len(raw) // 12
            items.append((np.frombuffer(raw, U, n), np.frombuffer(raw, np.uint32, n, 8 * n)))
        at: dict[int, list[int]] = {}
        for i, name in enumerate(sets.column("node").to_pylist()):
            at.setdefault(name, []).append(i)
        keep = np.zeros(len(pairs), bool)
        for i, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)):
            for p in at[a]:
                for q in at[b]:
                    n, m = len(items[p][0]), len(items[q][0])
                    if not keep[i] and min(n, m) * 100 >= percent * max(n, m):
                        inter = common(items[p], items[q])
                        keep[i] = 100 * inter >= percent * (n + m - inter)
        return pairs.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(likely: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among likely (g, a, b).  A group's sets travel once, not once for each pair."""
    likely = materialize(likely, "likely")
    member = materialize(likely.select("g", F.col("a").alias("node")).union(likely.select("g", "b")).distinct(), "members")
    wanted, texts = member.select(F.col("node").alias("doc_id")).distinct(), docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if wanted.count() <= BROADCAST_IDS:  # ids of bounded number; beyond, an ordinary join
        wanted = F.broadcast(wanted)
    sets = materialize(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_set_batches(k), "node long, items binary"), "sets")
    lots = max(16, member.count() // 1000)
    lot = F.pmod("g", F.lit(lots)).alias("lot")
    own = member.select(lot, "node").distinct().join(sets, "node").select("lot", "node", "items")
    pairs = likely.select(lot, "a", "b").distinct()
    links = materialize(pairs.groupBy("lot").cogroup(own.groupBy("lot")).applyInArrow(_check(percent), "a long, b long").distinct(), "links")
    drop(likely, member, sets)
    return links


def _frequent_keys(member: DataFrame, n: int) -> DataFrame | None:
    """Keys of buckets that look large in a sample of about LOOKED_AT nodes, at most some ten thousand.

    The sample only chooses the way that their rows go."""
    least = max(16, min(n, LOOKED_AT) // FREQUENT)
    near = (F.xxhash64("node", F.lit(17)).cast("double") / 2.0**64 + 0.5) * n < LOOKED_AT
    found = member.filter(near).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("key").collect()
    return member.sparkSession.createDataFrame(found, "key long") if found else None


def _with_extremes(rows: DataFrame, hot: DataFrame | None, value: Column) -> DataFrame:
    """rows with the least and greatest value of their key, lo and hi: one exchange, but for hot keys, whose
    extremes are combined before it and sent to where their rows lie."""
    ends = {"lo": F.min(value), "hi": F.max(value)}
    same = Window.partitionBy("key")
    over = lambda x: x.withColumns({c: e.over(same) for c, e in ends.items()})
    if hot is None:
        return over(rows)
    few = F.broadcast(hot)
    warm = rows.join(few, "key", "left_semi")
    known = warm.groupBy("key").agg(*[e.alias(c) for c, e in ends.items()])
    return over(rows.join(few, "key", "left_anti")).unionByName(warm.join(F.broadcast(known), "key"))


def _unsettled(shared: DataFrame, comp: DataFrame, hot: DataFrame | None) -> DataFrame:
    """key, band, node, c: rows of buckets whose members lie in different components."""
    placed = shared.join(comp, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("c"))
    return _with_extremes(placed, hot, F.col("c")).filter("lo <> hi").drop("lo", "hi")


def _crowded(rest: DataFrame) -> bool:
    """Whether comparing all pairs of different components in the buckets is much more than going through their rows."""
    sizes = rest.groupBy("key", "c").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    r = sizes.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
    return r.rows is not None and r.pairs > max(CROWDED * r.rows, LEAST_PAIRS)


def _merged(comp: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links: only those that the links touch are worked on."""
    ends = more.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    over = materialize(connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "components")
    own = over.select(F.col("node").alias("component"), F.col("component").alias("over"))
    lone = over.join(comp, "node", "left_anti")
    out = materialize(comp.join(own, "component", "left").select("node", F.coalesce("over", "component").alias("component")).unionByName(lone), "components")
    drop(over, comp)
    return out


def with_set_names(docs: DataFrame, k: int) -> DataFrame:
    """docs (all columns) with the 128-bit name of each row's shingle set, set_name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            own1, own2, at = shingles(block, k)
            halves = mix(_row_sums(own1, at)).tolist(), mix(_row_sums(own2, at)).tolist()
            names = pa.array([f"{a:016X}{b:016X}" for a, b in zip(*halves, strict=True)], pa.string())
            yield block.batch.slice(block.lo, block.rows).append_column("set_name", names)
        give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("set_name", StringType())]))


def set_name(h1: str, h2: str) -> Column:
    """The set_name of two halves: both numbers in hexadecimal."""
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, named: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate classes of documents
    (and h1, h2, the two halves of each row's set_name, if ``named``).

    Sets are distinct k-word shingles; documents link when
    ``100 * intersection >= percent * union``.  Equal sets are collapsed to
    their smallest doc_id first; each bucket of a band then links its members
    to its smallest one, and after components are known only members of
    different components in a bucket are compared, so that groups of copies
    never expand into all their pairs.  Where that would still be very many, other
    members lead their buckets in up to MOST_TURNS turns first, which leaves few components.

    Null or empty text, or text without words: an empty set, linked with
    nothing, kept.  Null doc_id: the row is returned with a null component and
    kept.  Rows that repeat a doc_id are one document for linking.  An empty
    table gives an empty result; other columns are ignored."""
    docs = docs.select("doc_id", "text")
    all_rows = materialize(sketch(docs, k), "sketch")
    sized = all_rows.filter("n_shingles > 0 and doc_id is not null")
    reps = materialize(sized.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node")), "reps")
    nodes = materialize(
        sized.withColumnRenamed("doc_id", "node").join(reps, ["node", "h1", "h2", "n_shingles"], "left_semi").select("node", "n_shingles", "regs", "h1", "h2").dropDuplicates(["node", "h1", "h2"]),
        "nodes",
    )
    bands = F.transform(F.sequence(F.lit(0), F.lit(M // ROWS - 1)), lambda b: F.xxhash64(b, F.slice("regs", b * ROWS + 1, ROWS)))
    member = nodes.select("node", F.posexplode(bands).alias("band", "key"))
    hot = _frequent_keys(member, nodes.count())
    led = _with_extremes(member, hot, F.col("node")).filter("lo <> hi")
    shared = materialize(led.select("key", "band", "node", F.col("lo").alias("a")), "buckets")
    stars = materialize(shared.filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "stars")
    links = _verified(_likely_stars(stars, nodes, percent / 100), docs, k, percent)
    drop(stars)
    comp = materialize(connected_components(links), "components")
    drop(links)
    for turn in range(MOST_TURNS + 1):
        rest = materialize(_unsettled(shared, comp, hot), "rest")
        last = turn == MOST_TURNS or not _crowded(rest)
        if last:
            likely = _likely_rest(rest, nodes, percent / 100)
        else:
            # in large buckets of many components others lead in turn, the same ones in a group's buckets
            lead = F.min_by(F.struct("node", "c"), F.xxhash64("node", F.lit(turn)))
            lead = rest.groupBy("key").agg(lead.alias("l")).select("key", F.col("l.node").alias("x"), F.col("l.c").alias("cx"))
            pairs = join_keys(rest, lead, "key").filter("c <> cx").select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
            likely = _likely_stars(materialize(pairs, "stars"), nodes, percent / 100)
        more = _verified(likely, docs, k, percent)
        found = not more.isEmpty()
        if found:
            comp = _merged(comp, more)
        drop(rest, more)
        if last:
            break
    drop(shared, nodes)

    classes = reps.join(comp, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    found = all_rows.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    cid = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(own, F.col("doc_id")))
    out = found.select("doc_id", "n_shingles", cid.alias("component_id"), *(["h1", "h2"] if named else []))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

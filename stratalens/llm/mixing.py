"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree domain - language - source.  A token budget flows down by
weights; a node that can't use its share (its supply times the allowed epochs)
leaves the rest to its siblings first, and only what they can't use either goes
to the ancestors' other branches.  Each leaf then takes whole epochs of its
documents and a prefix, in seeded order, of the next one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

SCALE = 1_000_000
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Targets:
    """Weights by level and name; a name that isn't listed has weight ``other``."""

    domain: Mapping[str, float] = field(default_factory=dict)
    lang: Mapping[str, float] = field(default_factory=dict)
    source: Mapping[str, float] = field(default_factory=dict)
    other: float = 1.0

    def weight(self, level: str, name: str) -> int:
        return round(SCALE * getattr(self, level).get(name, self.other))


def fill(budget: int, nodes: list[tuple[str, int, int]]) -> dict[str, int]:
    """Shares of ``budget`` for (name, weight, capacity) siblings: by weight, none
    over its capacity, shortages given to the others by weight.  Whole tokens that
    rounding leaves go to the first names."""
    out = {name: 0 for name, _, _ in nodes}
    open_nodes = [(n, w, c) for n, w, c in sorted(nodes) if w > 0 and c > 0]
    left = min(budget, sum(c for _, _, c in open_nodes))
    while left > 0 and open_nodes:
        total = sum(w for _, w, _ in open_nodes)
        full = [(n, w, c) for n, w, c in open_nodes if c * total <= left * w]
        if full:
            for n, _, c in full:
                out[n] = c
                left -= c
            gone = {n for n, _, _ in full}
            open_nodes = [x for x in open_nodes if x[0] not in gone]
            continue
        shares = [(n, left * w // total) for n, w, _ in open_nodes]
        rest = left - sum(s for _, s in shares)
        for i, (n, s) in enumerate(shares):
            out[n] = s + (i < rest)
        left = 0
    return out


def budgets(supply: dict[tuple[str, ...], int], targets: Targets, total: int, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf (domain, lang, source)."""

    def capacity(prefix: tuple[str, ...]) -> int:
        return caps.get(prefix, 0)

    caps: dict[tuple[str, ...], int] = {}
    kids: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for leaf, n in supply.items():
        if all(targets.weight(lv, leaf[i]) > 0 for i, lv in enumerate(LEVELS)):
            for d in range(len(leaf) + 1):
                caps[leaf[:d]] = caps.get(leaf[:d], 0) + n * max_epochs
        for d in range(len(leaf)):
            kids.setdefault(leaf[:d], set()).add(leaf[: d + 1])
    out: dict[tuple[str, ...], int] = {}
    todo = [((), total)]
    while todo:
        node, budget = todo.pop()
        if len(node) == len(LEVELS):
            out[node] = budget
            continue
        level = LEVELS[len(node)]
        below = sorted(kids.get(node, ()))
        shares = fill(budget, [(k[-1], targets.weight(level, k[-1]), capacity(k)) for k in below])
        todo += [(k, shares[k[-1]]) for k in below]
    return out


def _keyed(docs: DataFrame, domain: Column) -> DataFrame:
    """row (all columns), the leaf's names (null: "none") and n_tokens (words)."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"),
        words.cast("long").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("key"),
    )


def mix(
    docs: DataFrame, domain: Column, targets: Targets, fraction: float = 1.0, max_epochs: int = 1, seed: int = 1, max_leaves: int = 200_000, chunk: int = 2000
) -> DataFrame:
    """row (the document's columns), domain, lang, source, n_tokens, epoch.

    ``fraction`` of all tokens (words) is the budget.  A leaf with budget b and
    supply s gives ``b // s`` whole epochs and, of the next epoch's order (a hash of
    seed, epoch and document), the longest prefix with at most ``b % s`` tokens.
    Documents of equal hash (repeated rows) are taken or left together.

    Null domain, lang or source: the name "none".  Null or empty text: 0 tokens; in a
    leaf of supply 0 nothing is taken.  Weight 0 excludes a branch.  Null and repeated
    doc_ids pass through; extra columns stay in ``row`` whatever their names; an empty
    table gives none.

    One row for each leaf comes to the driver; more than ``max_leaves`` is an
    error.  The prefix needs no sort of a whole leaf: the order is cut into stretches
    of about ``chunk`` documents, their sums find the stretch in which the budget ends,
    and only its documents are sorted."""
    keyed = _keyed(docs, domain)
    spark = docs.sparkSession
    small = materialize(keyed.select(*LEVELS, "n_tokens", "key"), "tokens")
    leaves = small.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("docs"))
    found = leaves.limit(max_leaves + 1).collect()
    if len(found) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves: give coarser sources or raise max_leaves")
    supply = {tuple(r[lv] for lv in LEVELS): r.supply for r in found}
    total = int(sum(supply.values()) * fraction)
    given = budgets(supply, targets, total, max_epochs)
    plan = [(*leaf, given[leaf] // s, given[leaf] % s, max(1, -(-n // chunk))) for leaf, s, n in ((tuple(r[lv] for lv in LEVELS), r.supply, r.docs) for r in found) if s > 0]
    table = F.broadcast(spark.createDataFrame(plan, "domain string, lang string, source string, whole long, rest long, stretches long"))
    # where the partial epoch's order is cut
    h = F.xxhash64(F.lit(seed), F.col("whole"), F.col("key"))
    placed = small.join(table.filter("rest > 0"), list(LEVELS)).withColumn("h", h)
    unit = F.col("h").cast("double") / 2.0**64 + 0.5
    placed = placed.withColumn("stretch", F.least(F.floor(unit * F.col("stretches")), F.col("stretches") - 1))
    sums = materialize(placed.groupBy(*LEVELS, "stretch").agg(F.sum("n_tokens").alias("n")), "sums")
    upto = sums.join(table, list(LEVELS)).selectExpr(*LEVELS, "stretch", "n", "rest", f"sum(n) OVER (PARTITION BY {', '.join(LEVELS)} ORDER BY stretch) AS upto")
    # the stretch where the budget ends; none if the last one ends before (can't be: rest < supply)
    edge = upto.filter("upto > rest AND upto - n <= rest").selectExpr(*LEVELS, "stretch", "upto - n AS before", "rest AS allowed")
    edge = edge.groupBy(*LEVELS).agg(F.min_by(F.struct("stretch", "before", "allowed"), "stretch").alias("e")).selectExpr(*LEVELS, "e.stretch", "e.before", "e.allowed")
    inside = placed.join(edge, [*LEVELS, "stretch"]).groupBy(*LEVELS, "h", "before", "allowed").agg(F.sum("n_tokens").alias("n"))
    run = inside.selectExpr(*LEVELS, "h", "allowed", f"before + sum(n) OVER (PARTITION BY {', '.join(LEVELS)} ORDER BY h) AS upto")
    cuts = run.groupBy(*LEVELS).agg(F.min(F.when(F.col("upto") > F.col("allowed"), F.col("h"))).alias("stop")).collect()
    stops = {tuple(r[lv] for lv in LEVELS): r.stop for r in cuts}
    final = [(*p[:3], p[3], p[4] > 0, stops.get(tuple(p[:3]))) for p in plan]
    chosen = F.broadcast(spark.createDataFrame(final, "domain string, lang string, source string, whole long, part boolean, stop long"))
    taken = keyed.join(chosen, list(LEVELS)).withColumn("copies", F.col("whole") + F.when(F.col("part") & (F.col("stop").isNull() | (h < F.col("stop"))), 1).otherwise(0))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return taken.filter("copies > 0").select("row", *LEVELS, "n_tokens", epochs.alias("epoch"))

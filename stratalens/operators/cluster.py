"""Concepts: symbols of a package clustered by their embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cluster_count, member_hash, package_of
from ..functions.vectors import l2_distance, mean_vectors

TARGET_SIZE, SEEDS = 20, 100_000


def _lloyd(x: np.ndarray, centres: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Labels and inertia of Lloyd's iteration; an emptied centre takes the farthest point."""
    labels = None
    for _ in range(steps):
        new, d = nearest(x, centres)
        if labels is not None and (new == labels).all():
            break
        labels = new
        centres = centres.copy()
        for k in range(len(centres)):
            own = x[labels == k]
            if len(own):
                centres[k] = own.mean(0)
            else:
                far = int(d.argmax())
                centres[k], d[far] = x[far], -1
    return labels, float(sum(((x[labels == k] - c) ** 2).sum() for k, c in enumerate(centres)))


def nearest(x: np.ndarray, centres: np.ndarray, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance, in blocks of at most ``cells`` distances."""
    step = max(1, cells // max(1, len(centres) * (x.shape[1] if len(x) * len(centres) * x.shape[1] < cells else 1)))
    labels, least = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        d = ((part[:, None, :] - centres[None]) ** 2).sum(2) if len(part) * len(centres) * x.shape[1] <= cells else _distances(part, centres)
        labels[lo : lo + step] = d.argmin(1)
        least[lo : lo + step] = d.min(1)
    return labels, least


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeding."""
    chosen = [int(rng.integers(len(x)))]
    d = _distances(x, x[chosen])[:, 0]
    for _ in range(k - 1):
        total = d.sum()
        nxt = int(rng.choice(len(x), p=d / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(nxt)
        d = np.minimum(d, _distances(x, x[[nxt]])[:, 0])
    return x[chosen].copy()


def kmeans(x: np.ndarray, k: int, start: np.ndarray | None = None, tries: int = 3, seed: int = 42) -> np.ndarray:
    """Labels of the best of ``tries`` runs; one run from ``start`` if its shape fits."""
    x = np.asarray(x, np.float64)
    if k <= 1 or len(x) <= 1:
        return np.zeros(len(x), int)
    k = min(k, len(x))
    if start is not None and start.shape == (k, x.shape[1]):
        return _lloyd(x, np.asarray(start, np.float64))[0]
    rng = np.random.default_rng(seed)
    runs = [_lloyd(x, _spread_start(x, k, rng)) for _ in range(tries)]
    return min(runs, key=lambda r: r[1])[0]


def assign(embedded: DataFrame, previous: DataFrame | None = None, target_size: int = TARGET_SIZE, most: int = 20_000) -> DataFrame:
    """symbol_id, package, label for (symbol_id, path, embedding).

    A package of n symbols has max(1, n / target_size, halves to even) clusters.
    Packages of one cluster stay in the JVM; the others are clustered one group a
    package, warm from ``previous`` (package, centroid) where number and width fit.  A
    package of more than ``most`` symbols is first dealt out to the nearest of some of
    its own vectors, about one for each most / 4 symbols, and the parts are clustered;
    its clusters may be a few more or less than n / target_size."""
    rows = embedded.select("symbol_id", package_of(F.col("path")).alias("package"), "embedding")
    counts = rows.groupBy("package").agg(F.count("*").alias("n"))
    large = counts.filter(F.col("n") > most).collect()  # at most one for each ``most`` symbols
    rows = rows.join(counts.select("package", "n", cluster_count(F.col("n"), target_size).alias("k")), "package")
    if large:
        huge = rows.filter(F.col("n") > most)
        return assign_small(rows.filter(F.col("n") <= most), previous).unionByName(_assign_large(huge, {r.package: r.n for r in large}, target_size, most))
    return assign_small(rows, previous)


def _assign_large(rows: DataFrame, sizes: dict[str, int], target_size: int, most: int) -> DataFrame:
    """Packages of many symbols: their rows are dealt to parts, which are clustered one group each.

    SEEDS vectors at most, drawn by a hash, come to the driver and go out with the job."""
    share = min(4.0 / most, SEEDS / 2 / sum(sizes.values()))
    unit = F.xxhash64("symbol_id", F.lit(42)).cast("double") / 2.0**64 + 0.5
    drawn = rows.filter(unit < share).select("package", "symbol_id", "embedding").limit(SEEDS).toPandas().sort_values("symbol_id")
    seeds = {p: np.stack(own["embedding"].to_numpy()).astype(float) for p, own in drawn.groupby("package")}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = np.zeros(len(batch), np.int32)
            for package, at in batch.groupby("package").indices.items():
                if package in seeds:
                    part[at] = nearest(np.stack(batch["embedding"].iloc[at].to_numpy()).astype(float), seeds[package])[0]
            yield batch.assign(part=part)

    dealt = rows.select("symbol_id", "package", "embedding").mapInPandas(deal, f"symbol_id long, package string, embedding {rows.schema['embedding'].dataType.simpleString()}, part int")
    counts = dealt.groupBy("package", "part").agg(F.count("*").alias("n")).select("package", "part", cluster_count(F.col("n"), target_size).alias("k"))
    begin = F.sum("k").over(Window.partitionBy("package").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("begin", F.coalesce(begin, F.lit(0)).cast("int"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("symbol_id")
        labels = kmeans(np.stack(x["embedding"].to_numpy()), int(x["k"].iloc[0]), tries=1) + int(x["begin"].iloc[0])
        return pd.DataFrame({"symbol_id": x["symbol_id"], "package": x["package"], "label": labels.astype("int32")})

    return dealt.join(counts, ["package", "part"]).groupBy("package", "part").applyInPandas(run, "symbol_id long, package string, label int")


def assign_small(rows: DataFrame, previous: DataFrame | None) -> DataFrame:
    """The same for rows with package and k, one group a package."""
    single = rows.filter("k = 1").select("symbol_id", "package", F.lit(0).alias("label"))
    several = rows.filter("k > 1")
    schema = "symbol_id long, package string, label int"

    def run(x: pd.DataFrame, start: np.ndarray | None) -> pd.DataFrame:
        x = x.sort_values("symbol_id")
        labels = kmeans(np.stack(x["embedding"].to_numpy()), int(x["k"].iloc[0]), start)
        return pd.DataFrame({"symbol_id": x["symbol_id"], "package": x["package"], "label": labels.astype("int32")})

    if previous is None:
        grouped = several.groupBy("package").applyInPandas(lambda x: run(x, None), schema)
    else:

        def warm(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(x):
                return pd.DataFrame({"symbol_id": pd.Series(dtype="int64"), "package": pd.Series(dtype=str), "label": pd.Series(dtype="int32")})
            widths = {len(c) for c in p["centroid"]}
            return run(x, np.stack(p.sort_values("concept_id")["centroid"].to_numpy()) if len(widths) == 1 else None)

        grouped = several.groupBy("package").cogroup(previous.select("package", "concept_id", "centroid").groupBy("package")).applyInPandas(warm, schema)
    return single.unionByName(grouped)


def round_robin(symbols: DataFrame, target_size: int = TARGET_SIZE) -> DataFrame:
    """The same columns without embeddings: symbols of a package dealt out in id order."""
    rows = symbols.select("symbol_id", package_of(F.col("path")).alias("package"))
    sizes = rows.groupBy("package").agg(F.count("*").alias("n")).select("package", cluster_count(F.col("n"), target_size).alias("k"))
    place = F.row_number().over(Window.partitionBy("package").orderBy("symbol_id"))
    return rows.join(sizes, "package").select("symbol_id", "package", F.pmod(place - 1, F.col("k")).cast("int").alias("label"))


def counters() -> list:
    """Aggregates of a concepts table: concepts, those that keep a name, packages."""
    return [F.count("*").alias("concepts"), F.count("name").alias("reused"), F.countDistinct("package").alias("packages")]


def build_concepts(labels: DataFrame, embedded: DataFrame, hashes: DataFrame, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(concepts, concept_members) for (symbol_id, package, label), embeddings and
    content hashes; name, description and role are carried over from a previous
    concept with the same member hash."""
    rows = labels.join(embedded.select("symbol_id", "embedding"), "symbol_id").join(hashes.select("symbol_id", "content_hash"), "symbol_id")
    rows = rows.withColumn("concept_id", F.xxhash64("package", "label"))
    heads = rows.groupBy("concept_id").agg(F.first("package").alias("package"), F.count("*").cast("int").alias("member_count"), member_hash(F.col("content_hash")).alias("member_hash"))
    centres = mean_vectors(rows, ["concept_id"], "embedding").withColumnRenamed("embedding", "centre")
    concepts = heads.join(centres, "concept_id")
    if previous is not None:
        known = previous.filter(F.col("name").isNotNull()).groupBy("member_hash").agg(F.max_by(F.struct("name", "description", "role"), "concept_id").alias("old"))
        concepts = concepts.join(known, "member_hash", "left")
    else:
        concepts = concepts.withColumn("old", F.lit(None).cast("struct<name:string,description:string,role:string>"))
    members = rows.join(centres, "concept_id").select("concept_id", "symbol_id", l2_distance(F.col("embedding"), F.col("centre")).alias("distance_to_centroid"))
    concepts = concepts.select(
        "concept_id", "package", F.col("old.name").alias("name"), F.col("old.description").alias("description"), F.col("old.role").alias("role"),
        F.col("centre").cast("array<float>").alias("centroid"), "member_count", "member_hash",
    )
    return concepts, members

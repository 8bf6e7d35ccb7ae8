"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, join_keys, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, a written table.  Each node's neighbours are pointed at the
    smallest of them; minima are pre-aggregated and joined back, hubs by broadcast, so that
    the neighbours of one node are never gathered."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = join_keys(both, low, "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge to a node that has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    worst = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least")).agg(F.max(F.col("ups") + (1 - F.col("least")) * F.col("ups"))).first()[0]
    return worst is None or worst <= 1


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (node, component), component the smallest node.

    Nodes without links are not returned.  Each half round is written to the shared
    folder; only ids of hubs, a bounded number, and one figure come to the driver."""
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        if _settled(edges):
            break
        half = materialize(_star(edges, True), "edges")
        drop(edges)
        edges = materialize(_star(half, False), "edges")
        drop(half)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

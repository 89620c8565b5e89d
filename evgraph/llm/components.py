"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import lookup, materialize


def _minima(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(
        F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree")
    )


def _signature(edges: DataFrame) -> tuple:
    """Count and order-free checksum; the only values that reach the driver."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    ).first()
    return row[0], row[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs => ``(node, root)`` for each node of an edge, root the smallest node reached.

    Each round links a node's larger neighbours to its smallest one (large star), then its
    smaller neighbours and itself (small star); the graph ends as stars around the roots.
    Every round is cut off as a table in the shared folder. Hubs go through ``lookup``.
    Self-loops and repeated edges do no harm; an empty input gives an empty result.
    """
    edges = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = _signature(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lookup(both, _minima(both), "u", "degree", 2 * before[0])
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        n = large.count()
        small = lookup(large, _minima(large), "u", "degree", n)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u <> v").distinct(), "small-star")
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

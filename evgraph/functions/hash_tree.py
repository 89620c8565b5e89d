"""A hash tree over a graph's records: what changed is told by few nodes, and a change redoes few of them.

A record's place is the beginning of the digest of its part and id, so that it never moves. A leaf holds the records whose digests begin alike, each node
above the sixteen that go on from its own beginning. Two trees of one depth have equal nodes exactly where the graphs have equal records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions.canonical import canonical_rows
from evgraph.plans.shared import materialize

#: Records of a leaf, at most on average.
LEAF_ROWS = 1024
#: Levels that a tree may have; with LEAF_ROWS records a leaf, enough for 10^17 records.
MAX_DEPTH = 12


def depth_of(rows: int) -> int:
    """The least depth with LEAF_ROWS records or fewer in a leaf, on average."""
    depth = 0
    while LEAF_ROWS * 16**depth < rows:
        depth += 1
    return depth


def placed(nodes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """``part``, ``id``, ``sha256`` (of the record) and ``place`` of each record, with ``more`` of its columns."""
    rows = canonical_rows(nodes, edges, *more).select("part", "id", "sha256", *more)
    return rows.withColumn("place", F.sha2(F.concat_ws(":", "part", "id"), 256))


def _leaves(rows: DataFrame, depth: int) -> DataFrame:
    # digests move as bytes, whose order is that of their text
    digests = F.array_sort(F.collect_list(F.struct("part", F.unhex("sha256").alias("sha"))))
    digests = F.array_join(F.transform(digests, lambda x: F.concat_ws(":", x["part"], F.lower(F.hex(x["sha"])))), "\n")
    leaves = rows.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(digests, 256).alias("hash"))
    return leaves.select(F.lit(depth).alias("level"), "prefix", "rows", "hash")


def _parents(level: DataFrame, depth: int) -> DataFrame:
    """The nodes of ``depth`` above those of the level below it."""
    children = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "hash"))), "\n")  # sixteen at most
    nodes = level.groupBy(F.substring("prefix", 1, depth).alias("parent")).agg(F.sum("rows").alias("rows"), F.sha2(children, 256).alias("hash"))
    return nodes.select(F.lit(depth).alias("level"), F.col("parent").alias("prefix"), "rows", "hash")


def leaf_rows(nodes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """What ``build`` needs of ``placed`` records, as a table: the graph is computed once for the count and for all trees."""
    rows = placed(nodes, edges, *more).withColumn("sha", F.unhex("sha256")).withColumn("place", F.substring("place", 1, MAX_DEPTH))
    return materialize(rows.select("part", "sha", "place", *more), "hash-rows", "zstd").withColumn("sha256", F.lower(F.hex("sha")))


def build(rows: DataFrame, depth: int) -> DataFrame:
    """``placed`` records => ``level`` (0 at the root), ``prefix``, ``rows`` and ``hash`` of each node that holds any."""
    level = materialize(_leaves(rows, depth), "hash-leaves")
    levels = [level]
    for at in reversed(range(depth)):
        level = materialize(_parents(level, at), f"hash-level-{at}")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def refresh(tree: DataFrame, rows: DataFrame, touched: DataFrame, depth: int) -> DataFrame:
    """The tree after the records ``touched(part, id)`` were changed, added or removed; ``rows`` are the placed records as they are now.

    Only leaves of touched records are hashed again, and the nodes above these; all others are taken over.
    """
    place = F.sha2(F.concat_ws(":", "part", "id"), 256)
    prefixes = touched.select(F.substring(place, 1, depth).alias("prefix")).distinct()
    prefixes = materialize(prefixes, "touched-leaves")
    again = rows.withColumn("prefix", F.substring("place", 1, depth)).join(prefixes, "prefix", "left_semi")
    level = materialize(_leaves(again, depth), "hash-leaves")
    levels = [_kept(tree, prefixes, depth).unionByName(level)]
    for at in reversed(range(depth)):
        above = materialize(prefixes.select(F.substring("prefix", 1, at).alias("prefix")).distinct(), "touched-nodes")
        inside = levels[-1].withColumn("parent", F.substring("prefix", 1, at)).join(above.withColumnRenamed("prefix", "parent"), "parent", "left_semi")
        levels.append(_kept(tree, above, at).unionByName(materialize(_parents(inside.drop("parent"), at), f"hash-level-{at}")))
        prefixes = above
    return reduce(DataFrame.unionByName, levels)


def _kept(tree: DataFrame, prefixes: DataFrame, depth: int) -> DataFrame:
    return tree.where(F.col("level") == depth).join(prefixes, "prefix", "left_anti").select("level", "prefix", "rows", "hash")


def differing_leaves(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """Trees of one depth => ``prefix``, ``rows_a`` and ``rows_b`` of the leaves that differ.

    It goes down from the root: of each level, only nodes below one that differs are compared.
    """
    parents = None
    for level in range(depth + 1):
        sides = []
        for name, tree in (("a", a), ("b", b)):
            side = tree.where(F.col("level") == level)
            if parents is not None:
                above = parents.withColumnRenamed("prefix", "parent")
                side = side.withColumn("parent", F.substring("prefix", 1, level - 1)).join(above, "parent", "left_semi")
            sides.append(side.select("prefix", F.col("rows").alias(f"rows_{name}"), F.col("hash").alias(f"hash_{name}")))
        both = sides[0].join(sides[1], "prefix", "full_outer").where("NOT hash_a <=> hash_b")
        zero = {"rows_a": 0, "rows_b": 0}
        found = materialize(both.select("prefix", "rows_a", "rows_b").fillna(zero), f"differing-{level}")
        parents = found.select("prefix")
    return found


def differing_records(a: DataFrame, b: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """``part`` and ``id`` of placed records that only one graph has, or that differ; only those in ``leaves(prefix)`` are compared."""
    sides = []
    for name, rows in (("a", a), ("b", b)):
        inside = rows.withColumn("prefix", F.substring("place", 1, depth)).join(leaves.select("prefix"), "prefix", "left_semi")
        sides.append(inside.select("part", "id", F.col("sha256").alias(f"sha_{name}")))
    return sides[0].join(sides[1], ["part", "id"], "full_outer").where("NOT sha_a <=> sha_b").select("part", "id")

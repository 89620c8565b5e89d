"""The canonical text of a graph of any size: parts in order, their places, and one hash over all of them.

Pieces of the text (records and what stands between) are put in order by range partitions and numbered; each PIECES of them are a part, so that
the parts follow from the graph alone. Sums and hashes of parts go up a tree of FAN children a node, and places come down it: no window and no
group is larger than a node's children, but for one row a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions.canonical import edge_json, node_json
from evgraph.plans.shared import fresh_path, materialize
from evgraph.plans.stored import MIN_BUCKETS, numbered, write_bucketed

#: Pieces of a part, and children of a node of the tree over the parts.
PIECES, FAN = 1024, 1024
#: Pieces that one task puts together, some 100 MB of text.
BUCKET_PIECES = 1 << 18


def _pieces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``section`` and ``json``: records are in sections 1 (edges) and 3 (nodes), the text around them in 0, 2 and 4."""
    around = [(0, '{"edges":['), (2, '],"nodes":['), (4, "]}")]
    out = nodes.sparkSession.createDataFrame(around, "section int, json string")
    out = out.unionByName(edges.select(F.lit(1).alias("section"), edge_json().alias("json")))
    return out.unionByName(nodes.select(F.lit(3).alias("section"), node_json().alias("json")))


def _parts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """``part`` and ``text``, dealt by the part, and the number of buckets that they are dealt to."""
    placed = numbered(_pieces(nodes, edges), ["section", "json"], "ordered-pieces", "place")
    firsts = placed.groupBy("section").agg(F.min("place").alias("first"))  # five rows
    buckets = max(MIN_BUCKETS, -(-placed.count() // BUCKET_PIECES))
    comma = F.col("section").isin(1, 3) & (F.col("place") > F.col("first"))
    text = F.when(comma, F.concat(F.lit(","), "json")).otherwise(F.col("json"))
    placed = placed.join(F.broadcast(firsts), "section").select("place", text.alias("text"), F.floor(F.col("place") / PIECES).alias("part"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"])
    return placed.repartition(buckets, "part").groupBy("part").agg(F.array_join(pieces, "").alias("text")), buckets


def document_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part`` (from 0), ``text``, ``bytes`` (UTF-8) and ``sha256``: the texts one after the other are the graph's canonical JSON.

    The table is in buckets of the part, so that a join by it leaves the texts where they are.
    """
    parts, buckets = _parts(nodes, edges)
    parts = parts.select("part", "text", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return write_bucketed(parts, fresh_path(nodes.sparkSession, "text-parts"), "part", [], buckets, dealt=True)


def part_hashes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part``, ``bytes`` and ``sha256`` of ``document_parts``, whose texts are not kept."""
    parts, _ = _parts(nodes, edges)
    return materialize(parts.select("part", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256")), "part-hashes")


def levels_over(parts: DataFrame) -> list[DataFrame]:
    """The tree over ``parts(part, bytes, sha256)``, from the parts up to the root: ``node``, ``bytes`` and ``hash`` of each level."""
    level = parts.select(F.col("part").alias("node"), "bytes", F.col("sha256").alias("hash"))
    out = [level]
    while True:
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
        level = out[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(
            F.sum("bytes").alias("bytes"), F.sha2(F.array_join(hashes, "\n"), 256).alias("hash")
        )
        level = materialize(level, f"text-level-{len(out)}")
        out.append(level)
        if len(level.head(2)) < 2:
            return out


def starts(levels: list[DataFrame]) -> DataFrame:
    """``part`` and ``start``, the bytes of all parts before it, of the parts under a tree."""
    at = levels[-1].select("node", F.lit(0).cast("long").alias("start"))
    siblings = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    for level in reversed(levels[:-1]):
        inner = level.withColumn("parent", F.floor(F.col("node") / FAN)).withColumn("before", F.coalesce(F.sum("bytes").over(siblings), F.lit(0)))
        above = at.select(F.col("node").alias("parent"), F.col("start").alias("above"))
        at = inner.join(above, "parent").select("node", (F.col("above") + F.col("before")).cast("long").alias("start"))
    return at.withColumnRenamed("node", "part")


def root_of(levels: list[DataFrame]) -> DataFrame:
    """One row: ``bytes`` of the whole text and ``hash``, the root over the hashes of its parts."""
    return levels[-1].select("bytes", "hash")

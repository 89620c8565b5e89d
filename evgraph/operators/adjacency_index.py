"""Arcs on shared storage, both ways, so that neighbours, explanations and paths need not build them from all edges.

Arcs are put in the order of their node and ``seq`` and numbered; each BLOCK numbers are cut into one row a node. So a node with few arcs is a
row or two, a hub is many numbered blocks, and no row holds more than BLOCK arcs. Blocks are in buckets of their node; a table of offsets, in
buckets as well, says at which place of its node each block starts, so that a part of a hub is read without the rest.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evgraph.operators.graph import adjacency
from evgraph.operators.paths import BROADCAST_IDS
from evgraph.operators.skew import split_join
from evgraph.plans.shared import fresh_path, hadoop_path, materialize
from evgraph.plans.stored import buckets_for, lookup_rows, numbered, read_bucketed, write_bucketed

#: Arcs of a block at most, and blocks of a hub that one task writes.
BLOCK, PIECE = 1 << 12, 1 << 10


def _marked(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``arcs`` with ``from_known`` and ``to_known``, whether their ends are nodes.

    Ends that are no nodes are looked for among the different ids, and arcs move only if there are many of these.
    """
    # arcs go both ways, so each end is the start of one
    ends = arcs.select(F.col("from_id").alias("id")).distinct()
    unknown = materialize(ends.join(nodes.select("id"), "id", "left_anti"), "unknown-ends")
    few = unknown.count() <= BROADCAST_IDS
    for end in ("from", "to"):
        ids = unknown.select(F.col("id").alias(f"{end}_id"), F.lit(False).alias(f"{end}_known"))
        arcs = arcs.join(F.broadcast(ids), f"{end}_id", "left") if few else split_join(arcs, ids, f"{end}_id", ["seq"], "left")
        arcs = arcs.withColumn(f"{end}_known", F.coalesce(f"{end}_known", F.lit(True)))
    return arcs


@dataclass
class AdjacencyIndex:
    """``blocks(from_id, block, from_known, n, arcs)`` and ``offsets(from_id, block, start, n)``."""

    blocks: DataFrame
    offsets: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, path: str, buckets: int | None = None, block: int = BLOCK) -> AdjacencyIndex:
        """Index the arcs of ``graph.adjacency`` at ``path``, a new folder that all executors share.

        Ends that are no nodes keep their arcs, with a mark. Edges with equal ids are arcs each; arcs from or to a null id are left out.
        """
        path, spark = path.rstrip("/"), nodes.sparkSession
        arcs = adjacency(nodes, edges).where("from_id IS NOT NULL AND to_id IS NOT NULL").select("from_id", "seq", "to_id")
        arcs = _marked(arcs, nodes)
        placed = numbered(arcs, ["from_id", "seq", "to_id"], "index-arcs")
        arc = F.struct("number", "to_id", "to_known", "seq")
        buckets = buckets or buckets_for(placed.count())
        # arcs move once more, to the task that writes their blocks
        placed = placed.withColumn("block", F.floor(F.col("number") / block)).withColumn("_piece", F.floor(F.col("block") / PIECE))
        blocks = placed.repartition(buckets, "from_id", "_piece").groupBy("from_id", "_piece", "block").agg(
            F.first("from_known").alias("from_known"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(arc)).alias("arcs")
        )
        blocks = blocks.drop("_piece").withColumn("arcs", F.transform("arcs", lambda a: a.dropFields("number")))
        stored = write_bucketed(blocks, f"{path}/blocks", "from_id", ["block"], buckets, dealt=True)
        # a row for each BLOCK arcs
        before = Window.partitionBy("from_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = stored.select("from_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")
        offsets = write_bucketed(starts, f"{path}/offsets", "from_id", ["block"], buckets)
        about = {"buckets": buckets, "blocks": stored.schema.jsonValue(), "offsets": offsets.schema.jsonValue()}
        p, fs = hadoop_path(spark, f"{path}/index.json")
        out = fs.create(p, False)
        out.write(json.dumps(about).encode())
        out.close()
        return cls(stored, offsets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> AdjacencyIndex:
        """An index that is built; the file that says so is written last."""
        path = path.rstrip("/")
        about = json.loads(spark.read.text(f"{path}/index.json", wholetext=True).head()[0])
        read = lambda name: read_bucketed(spark, f"{path}/{name}", StructType.fromJson(about[name]), "from_id", ["block"], about["buckets"])
        return cls(read("blocks"), read("offsets"))

    def _of(self, table: DataFrame, ids: DataFrame) -> DataFrame:
        ids = ids.select(F.col("id").alias("from_id")).where("from_id IS NOT NULL").distinct()
        return lookup_rows(table, materialize(ids, "asked-nodes"), "from_id")

    @staticmethod
    def _unpacked(blocks: DataFrame, *more: str) -> DataFrame:
        return blocks.select("from_id", "from_known", *more, F.explode("arcs").alias("arc")).select(
            "from_id", "from_known", *more, "arc.to_id", "arc.to_known", "arc.seq"
        )

    def arcs(self, ids: DataFrame | None = None) -> DataFrame:
        """``from_id``, ``to_id``, ``seq`` and ``edge_id`` of all nodes or of those with ``ids(id)``, as ``graph.adjacency`` gives them."""
        arcs = self._unpacked(self.blocks if ids is None else self._of(self.blocks, ids))
        return arcs.select("from_id", "to_id", "seq", F.col("seq.edge_id").alias("edge_id"))

    def places(self) -> DataFrame:
        """``from_id``, ``place``, ``to_id`` and ``seq``: each arc with its place among those of its node, gapless from 0."""
        started = self.blocks.join(self.offsets.select("from_id", "block", "start"), ["from_id", "block"])
        placed = started.select("from_id", "start", F.posexplode("arcs").alias("at", "arc"))
        return placed.select("from_id", (F.col("start") + F.col("at")).alias("place"), "arc.to_id", "arc.seq")

    def page(self, node_id: str, start: int, size: int) -> DataFrame:
        """The arcs of a node at the places from ``start`` on, ``size`` at most; only the blocks that hold them are unpacked."""
        here = self.offsets.where(F.col("from_id") == node_id)
        here = here.where((F.col("start") < start + size) & (F.col("start") + F.col("n") > start))
        # a page needs a block for each BLOCK of its arcs, and one at either end
        at = {row["block"]: row["start"] for row in here.select("block", "start").collect()}
        blocks = self.blocks.where((F.col("from_id") == node_id) & F.col("block").isin(sorted(at)))
        first: Column = F.create_map(*[F.lit(v) for pair in at.items() for v in pair])[F.col("block")] if at else F.lit(0).cast("long")
        placed = blocks.select("from_id", first.alias("start"), F.posexplode("arcs").alias("at", "arc"))
        placed = placed.select("from_id", (F.col("start") + F.col("at")).alias("place"), "arc.to_id", "arc.seq")
        return placed.where(F.col("place").between(start, start + size - 1))

    def degrees(self) -> DataFrame:
        """``id`` and ``n``, its number of arcs, from the offsets alone."""
        return self.offsets.groupBy(F.col("from_id").alias("id")).agg(F.sum("n").alias("n"))

    def explain(self, ids: DataFrame) -> DataFrame:
        """``direction``, ``id``, ``src`` and ``dst`` of each stored edge of ``ids(id)``; a loop comes once in each, ids that are no nodes have none."""
        arcs = self._unpacked(self._of(self.blocks, ids)).where("from_known AND seq.source = 0")
        out = F.col("seq.way") == 0
        return arcs.select(
            F.when(out, "outgoing").otherwise("incoming").alias("direction"), F.col("seq.edge_id").alias("id"),
            F.when(out, F.col("from_id")).otherwise(F.col("to_id")).alias("src"), F.when(out, F.col("to_id")).otherwise(F.col("from_id")).alias("dst"),
        )

    def neighbors(self, focus: DataFrame, mode: str = "expand") -> DataFrame:
        """``focus`` and ``id`` of the nodes one step from ``focus(id)``, as ``graph.neighbors`` gives them for ``upstream``, ``downstream`` and ``expand``."""
        arcs = self._unpacked(self._of(self.blocks, focus)).where("seq.source = 0 AND to_known AND from_id <> to_id")
        if mode != "expand":
            arcs = arcs.where(F.col("seq.way") == {"downstream": 0, "upstream": 1}[mode])
        return arcs.select(F.col("from_id").alias("focus"), F.col("to_id").alias("id")).distinct()


def index_of(nodes: DataFrame, edges: DataFrame) -> AdjacencyIndex:
    """An index in the shared folder, removed when the driver ends."""
    return AdjacencyIndex.build(nodes, edges, fresh_path(nodes.sparkSession, "adjacency-index"))

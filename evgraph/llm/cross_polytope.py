"""Near-duplicate vectors by cross-polytope hashing, with multiprobe buckets and verified pairs.

A vector is turned by random sign flips and fast Hadamard transforms, three times; the axis
nearest to the result, with its sign, is a hash. A table joins several hashes to a bucket.
Each vector is at home in one bucket of each table and also visits the buckets
that its second nearest axes give. Within a bucket, homes are compared with visits by their cosine in
double precision; a crowded bucket is divided in blocks of homes, which all its visitors go to. A pair counts in
the first table, and direction, in which it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm.common import deal, lookup, materialize, read_table
from evgraph.llm.components import components

MIN_COSINE = 0.95


@dataclass(frozen=True)
class Hashing:
    """``hashes`` of a table grow with the number of vectors, ``tables`` with the hashes, so that recall stays."""

    hashes: int
    tables: int
    seed: int = 3

    @classmethod
    def of(cls, vectors: int, width: int) -> Hashing:
        hashes = max(1, math.ceil(math.log(max(2, vectors / 8)) / math.log(2 * max(2, width))))
        return cls(hashes, 2 + 3 * hashes)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose width is a power of two."""
    rows, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(rows, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(rows, width) / math.sqrt(width)


def _axis_type(dims: int) -> np.dtype:
    return np.dtype("<u2") if dims <= 1 << 15 else np.dtype("<u4")


def axes_of(vectors: np.ndarray, hashing: Hashing) -> np.ndarray:
    """Nearest and second nearest axes of unit vectors, 2 * axis + sign: (row, table, rank, hash)."""
    rows, dims = vectors.shape
    width = 1 << max(1, (dims - 1).bit_length())
    padded = np.zeros((rows, width))
    padded[:, :dims] = vectors
    rng = np.random.default_rng([hashing.seed, dims])
    out = np.empty((rows, hashing.tables, 2, hashing.hashes), _axis_type(dims))
    at = np.arange(rows)
    for t in range(hashing.tables):
        for i in range(hashing.hashes):
            x = padded
            for _ in range(3):
                x = _hadamard(x * rng.choice([-1.0, 1.0], width))
            size = np.abs(x)
            for rank in (0, 1):
                best = size.argmax(axis=1)
                out[:, t, rank, i] = 2 * best + (x[at, best] < 0)
                size[at, best] = -1
    return out


def bucket_of(axes: np.ndarray, dims: int, probe: int) -> np.ndarray:
    """Buckets (row, table) from axes; probe 0 is the home, probe i the visit by the second axis of hash i."""
    width = 1 << max(1, (dims - 1).bit_length())
    bucket = np.full(axes.shape[:2], dims, np.int64)
    for i in range(axes.shape[3]):
        bucket = bucket * (2 * width) + axes[:, :, int(i == probe - 1), i]
    return bucket


def visits_home(visitor: np.ndarray, host: np.ndarray) -> np.ndarray:
    """For pairs of axes: (pair, table), whether the host's home is among the buckets of the visitor."""
    differ = host[:, :, 0] != visitor[:, :, 0]
    return (differ.sum(axis=2) <= 1) & (~differ | (host[:, :, 0] == visitor[:, :, 1])).all(axis=2)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _unit_rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors in double precision, for each width among the rows."""
    vectors = batch.column(column)
    offsets = np.diff(vectors.offsets.to_numpy())
    values, starts = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()[:-1]
    for dims in np.unique(offsets):
        at = np.flatnonzero(offsets == dims)
        yield at, _unit(values[starts[at][:, None] + np.arange(dims)])


def _homes(hashing: Hashing) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _unit_rows(batch, 0):
                found = bucket_of(axes_of(x, hashing), x.shape[1], 0)
                tables = np.broadcast_to(np.arange(hashing.tables, dtype=np.int32), found.shape)
                yield pa.RecordBatch.from_arrays([pa.array(tables.ravel()), pa.array(found.ravel())], ["table", "bucket"])

    return run


def _send(hashing: Hashing) -> Callable:
    """Each vector to its buckets: at home in one of each table, a visitor in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["table", "bucket", "home", "node", "copies", "axes", "vector"]
        for batch in batches:
            nodes, copies = batch.column(0), batch.column(1)
            for at, x in _unit_rows(batch, 2):
                axes, rows = axes_of(x, hashing), pa.array(at)
                packed = pa.array([a.tobytes() for a in axes], pa.binary())
                same = [nodes.take(rows), copies.take(rows), packed, batch.column(2).take(rows)]
                for probe in range(hashing.hashes + 1):
                    buckets = bucket_of(axes, x.shape[1], probe)
                    for t in range(hashing.tables):
                        own = [np.full(len(at), t, np.int32), buckets[:, t], np.full(len(at), probe == 0)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, own), *same], names)

    return run


def _compare(hashing: Hashing, min_cosine: float, block_rows: int = 2048) -> Callable:
    """Rows sorted by block, homes first => for each node of a block new links, and one node of its linked set.

    A block's homes are held; its rows, the homes among them, stream past these ``block_rows`` at once. Links are
    given out as they are found, so a node of a block can come several times.
    """

    def compared(table: int, hosts: tuple, rows: tuple):
        """New links between the homes and other rows, of which each is (node, copies, axes, unit vectors)."""
        (h_node, h_copies, h_axes, h_x), (node, copies, axes, x) = hosts, rows
        ids, at = np.unique(np.concatenate([h_node, node]), return_inverse=True)
        of_host, of_row = at[: len(h_node)], at[len(h_node) :]
        links, root, any_pair = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
        for i in range(0, len(h_node), block_rows):
            a, b = np.nonzero(h_x[i : i + block_rows] @ x.T >= min_cosine)
            a += i
            other = h_node[a] != node[b]
            a, b = a[other], b[other]
            for j in range(0, len(a), 1 << 16):
                p, q = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                there, back = visits_home(axes[q], h_axes[p]), visits_home(h_axes[p], axes[q])
                new = ~(there | back)[:, :table].any(axis=1) & (~back[:, table] | (h_node[p] < node[q]))
                np.add.at(links, of_host[p[new]], copies[q[new]])
                np.add.at(links, of_row[q[new]], h_copies[p[new]])
                u, v = of_host[p], of_row[q]
                any_pair[u] = any_pair[v] = True
                while True:  # the smallest index of each linked set
                    low = np.minimum(root[u], root[v])
                    before = root.copy()
                    np.minimum.at(root, u, low)
                    np.minimum.at(root, v, low)
                    root = root[root]
                    if (root == before).all():
                        break
        linked = np.flatnonzero(any_pair)
        return (ids[linked], links[linked], ids[root[linked]]) if len(linked) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, hosts = None, [], None

        def ready(parts: list[tuple]) -> tuple:
            return tuple(np.concatenate(side) for side in zip(*parts))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in range(3)]
            home, node, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 6))
            change = np.logical_or.reduce([np.diff(k) != 0 for k in keys]) | (np.diff(home.astype(np.int8)) != 0)
            bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
            out = []
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                here = tuple(int(k[start]) for k in keys)
                if here != key:
                    if homes and hosts is None:  # the last block had homes only
                        out += _with_homes(key[0], ready(homes))
                    key, homes, hosts = here, [], None
                if not home[start] and not homes:
                    continue
                vectors = batch.column(7).slice(start, end - start)
                x = _unit(vectors.flatten().to_numpy().reshape(end - start, -1))
                packed = b"".join(batch.column(6).slice(start, end - start).to_pylist())
                axes = np.frombuffer(packed, _axis_type(x.shape[1])).reshape(-1, hashing.tables, 2, hashing.hashes)
                rows = (node[start:end], copies[start:end], axes, x)
                if home[start]:
                    homes.append(rows)
                    continue
                if hosts is None:
                    hosts = ready(homes)
                    out += _with_homes(key[0], hosts)
                for at in range(0, end - start, block_rows):
                    out.append(compared(key[0], hosts, tuple(c[at : at + block_rows] for c in rows)))
            out = [x for x in out if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*out)], ["node", "links", "near"])
        if homes and hosts is None and (out := [x for x in _with_homes(key[0], ready(homes)) if x]):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*out)], ["node", "links", "near"])

    def _with_homes(table: int, hosts: tuple) -> list:
        """The homes of a block among themselves."""
        n = len(hosts[0])
        return [compared(table, hosts, tuple(c[at : at + block_rows] for c in hosts)) for at in range(0, n, block_rows)] if n > 1 else []

    return run


def is_usable(vector: Column) -> Column:
    """A vector that has a direction: no null or non-finite component, and not all zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda v: v != 0), F.lit(False))


def group_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE,
    hashing: Hashing | None = None, bucket_rows: int = 4096,
) -> DataFrame:
    """One row per input row: the id, ``n_links`` and ``component_id``.

    Equal vectors are one node with a count. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing and is its own component; so do vectors
    of different widths. ``component_id`` is the smallest id of the component. Ids may be null or repeated: null ids never
    name a component unless all of it are null, and different vectors of one id are different nodes. Recall depends on ``hashing``: pairs at the least cosine meet in
    some table with a probability that the tests measure; all pairs that meet are verified. Buckets
    with more than ``bucket_rows`` homes are divided in blocks of about so many, whatever the table's size.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    usable = rows.where(is_usable(F.col("vector")))
    sizes = F.count(F.lit(1)).alias("copies")
    # a node's number is the place of its vector in the table; ids may be null or shared, and only name
    nodes = usable.groupBy("vector").agg(F.min("vec_id").alias("first_id"), sizes)
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    hashing = hashing or Hashing.of(total, width or 1)
    homes = nodes.select("vector").mapInArrow(_homes(hashing), "table int, bucket long")
    homes = homes.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    # Spark broadcasts this table if it is small, and joins by shuffle if not
    crowded = materialize(homes.select("table", "bucket", F.ceil(F.col("n") / bucket_rows).alias("blocks")), "crowded-buckets")
    sent = nodes.select("node", "copies", "vector").mapInArrow(
        _send(hashing), f"table int, bucket long, home boolean, node long, copies long, axes binary, vector {kind}"
    )
    if crowded.isEmpty():
        sent = sent.withColumn("block", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
        sent = sent.join(crowded, ["table", "bucket"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
        block = F.explode(F.when(F.col("blocks") > 1, every).otherwise(F.array(F.lit(0))))
        sent = sent.withColumn("block", block).withColumn("home", F.col("home") & (F.col("own") == F.col("block")))
    key = ["table", "bucket", "block"]
    sent = sent.select(*key, "home", "node", "copies", "axes", "vector")
    row_bytes = 64 + 8 * (width or 1) + 4 * hashing.tables * hashing.hashes
    dealt = deal(sent, total * hashing.tables * (hashing.hashes + 1) * row_bytes, *key)
    dealt = dealt.sortWithinPartitions(*key, F.desc("home"))
    found = dealt.mapInArrow(_compare(hashing, min_cosine), "node long, links long, near long")
    found = materialize(found, "vector-links")
    roots = components(found.select(F.col("node").alias("u"), F.col("near").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    members = nodes.select("node", "first_id").join(roots, "node")
    members = materialize(members, "vector-members")
    named = members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = lookup(members, named, "root", "n", members.count()).select("node", "component_id")
    table = nodes.join(counts, "node", "left").join(linked.withColumn("linked", F.lit(True)), "node", "left")
    table = table.select(
        "vector", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("root"),
    )
    linked = lookup(usable, table, "vector", "copies", usable.count()).select("vec_id", "n_links", "root")
    alone = rows.where(~is_usable(F.col("vector"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("root")
    )
    return linked.unionByName(alone).select(F.col("vec_id").alias(id_col), "n_links", F.col("root").alias("component_id"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_vectors(read_table(spark, sf_dir, "embeddings"))
    # null-safe, so that a component without an id keeps its rows
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

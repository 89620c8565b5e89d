"""Hard negatives by product quantisation with stored residual norms.

Components become integers, so that scores are exact inner products. A vector's code names, for each pair of components, the
nearest of 256 centroids and the nearest of 256 for what is left; the norm of what is left after both is stored beside it. An anchor's
score lies within the sum of the centroids' scores, looked up in tables, plus or minus the anchor's norm times that residual norm. This
filters candidates rigorously: no row that belongs to a result is lost, whatever the codebooks are. The candidates that stay are scored
again in integers.

Anchors and rows meet in blocks: each block of rows is compared with each block of anchors, and gives at most as many rows an
anchor as the result takes, so that nothing but these moves on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.common import materialize, read_table, row_hash

#: The codebooks are learned from at most so many vectors, those of the smallest hashes. Bounds stay right for all others.
SAMPLE = 4096
CENTROIDS, COMPONENTS, STAGES, ROUNDS = 256, 2, 2, 5
#: Rows and anchors of a block, on average; anchors that are scored at once.
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE = 4096, 1024, 128
#: Pairs that are scored in integers at once.
EXACT_PAIRS = 1 << 16
#: Norms stay below this, so that an inner product is a long.
MAX_NORM = 2.0**31 * (1 - 1e-6)


@dataclass(frozen=True)
class Mining:
    """How many positives an anchor has, how many negatives each of these gets, and between which percentages of its score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256

    def window(self, score: int) -> tuple[int, int]:
        """The least and the greatest score that a negative may have beside a positive of ``score``."""
        return -(-self.low * score // 100), self.high * score // 100


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """``rows(id, label, vector, anchor)`` => those that take part, with ``x``, the vector in integers, and ``row_no``."""
    x = rows.withColumn("x", F.transform("vector", lambda v: v.cast("double") * scale))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MAX_NORM))
    x = x.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(finite)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda total, v: total + (F.abs(v) + 1) * (F.abs(v) + 1)))
    x = x.where(norm < MAX_NORM).withColumn("x", F.transform("x", lambda v: F.floor(v).cast("int")))
    return x.select(F.monotonically_increasing_id().alias("row_no"), "id", "label", "anchor", "x")


def learn_codebooks(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """Vectors of one width => centroids (stage, part, CENTROIDS, COMPONENTS); each stage is fitted to what the one before leaves."""
    rest = _parts(vectors.astype(np.float64))
    rows, parts, _ = rest.shape
    rng = np.random.default_rng(seed)
    books = np.empty((STAGES, parts, CENTROIDS, COMPONENTS))
    for stage in range(STAGES):
        for j in range(parts):
            points = rest[:, j]
            book = points[rng.choice(rows, CENTROIDS, replace=rows < CENTROIDS)]
            for _ in range(ROUNDS):
                near = _nearest(points, book)
                size = np.bincount(near, minlength=CENTROIDS)
                sums = np.stack([np.bincount(near, points[:, c], CENTROIDS) for c in range(COMPONENTS)], axis=1)
                book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
            books[stage, j] = book
            rest[:, j] -= book[_nearest(points, book)]
    return books


def _parts(x: np.ndarray) -> np.ndarray:
    """(row, part, COMPONENTS), filled up with zeros; a vector without components is one part of zeros."""
    rows, width = x.shape
    parts = max(1, -(-width // COMPONENTS))
    out = np.zeros((rows, parts * COMPONENTS))
    out[:, :width] = x
    return out.reshape(rows, parts, COMPONENTS)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * points @ book.T).argmin(axis=1)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, stage and part) and residual norms. The norms are rounded up by what sums of doubles may be off."""
    rest = _parts(x.astype(np.float64))
    rows, parts, _ = rest.shape
    code = np.empty((rows, STAGES * parts), np.uint8)
    sizes = np.sqrt((rest * rest).sum(axis=(1, 2)))
    for stage in range(STAGES):
        coded = np.empty_like(rest)
        for j in range(parts):
            near = _nearest(rest[:, j], books[stage, j])
            code[:, stage * parts + j] = near
            coded[:, j] = books[stage, j][near]
        rest = rest - coded
        sizes += np.sqrt((coded * coded).sum(axis=(1, 2)))
    residual = np.sqrt((rest * rest).sum(axis=(1, 2)))
    return code, residual * (1 + 1e-9) + sizes * (8 * parts + 64) * 2.3e-16


def looked_up(anchors: np.ndarray, code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Scores (row, anchor) of the coded rows, from one table of the centroids' scores for each part and stage."""
    q = _parts(anchors.astype(np.float64))
    parts = q.shape[1]
    out, taken = np.zeros((len(code), len(q))), np.empty((len(code), len(q)))
    for stage in range(STAGES):
        for j in range(parts):
            table = books[stage, j] @ q[:, j].T
            out += np.take(table, code[:, stage * parts + j], axis=0, out=taken)
    return out


class _Side:
    """One side of a block as arrays, sorted by label."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("label")
        self.number, self.label = table["row_no"].to_numpy(), table["label"].to_numpy()
        self.none = table["id"].is_null().to_numpy()
        self.id = table["id"].fill_null(0).to_numpy()
        self.x = _matrix(table["x"], np.dtype("<i4"), width).astype(np.int64)
        self.table = table

    def __len__(self) -> int:
        return len(self.number)

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))


def _matrix(column: pa.ChunkedArray, kind: np.dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _exact(rows: np.ndarray, anchors: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs."""
    out = np.empty(len(r), np.int64)
    for at in range(0, len(r), EXACT_PAIRS):
        to = slice(at, at + EXACT_PAIRS)
        out[to] = (rows[r[to]] * anchors[a[to]]).sum(axis=1)
    return out


def _first(group: np.ndarray, score: np.ndarray, none: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Of each group, where the ``k`` highest scores stand; ties by smaller id, null last."""
    order = np.lexsort((ident, none, -score, group))
    ordered = group[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


def _blocks(run: Callable, books: dict[int, np.ndarray], names: str) -> Callable:
    """``run`` over the arrays of a block; it gives tuples of arrays, the last two a row's id and whether it is null."""
    columns = names.split()

    def block(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        width = key[0].as_py()
        found = []
        if len(rows) and len(anchors):
            left, right = _Side(rows, width), _Side(anchors, width)
            book = books.get(width)
            if book is None:  # no vector of this width was in the sample: all centroids are zero, so all is residual
                book = np.zeros((STAGES, max(1, -(-width // COMPONENTS)), CENTROIDS, COMPONENTS))
            code = _matrix(left.table["code"], np.dtype("u1"), STAGES * book.shape[1])
            bound = left.table["bound"].to_numpy()
            found = list(run(book, left, code, bound, right))
        out = [np.concatenate(c) for c in zip(*found)] if found else [np.array([], np.int64)] * (len(columns) + 1)
        arrays = [pa.array(c, pa.int64()) for c in out[:-2]]
        arrays.append(pa.array(out[-2], pa.int64(), mask=out[-1].astype(bool)))
        return pa.table(arrays, names=columns)

    return block


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)


def _positives(k: int) -> Callable:
    def run(book, rows: _Side, code, bound, anchors: _Side):
        for label in np.intersect1d(rows.label, anchors.label):
            r, every = rows.of(label), anchors.of(label)
            for at in range(every.start, every.stop, AT_ONCE):
                a = slice(at, min(at + AT_ONCE, every.stop))
                score = looked_up(anchors.x[a], code[r], book)
                spread = bound[r][:, None] * _norms(anchors.x[a])[None, :] + 1e-6
                other = rows.number[r][:, None] != anchors.number[a][None, :]
                low = np.where(other, score - spread, -np.inf)
                kth = np.partition(low, len(low) - k, axis=0)[len(low) - k] if len(low) > k else -np.inf
                i, j = np.nonzero((score + spread >= kth) & other)
                i, j = i + r.start, j + a.start
                exact = _exact(rows.x, anchors.x, i, j)
                best = _first(j, exact, rows.none[i], rows.id[i], k)
                i, j = i[best], j[best]
                yield anchors.number[j], exact[best], rows.id[i], rows.none[i]

    return run


def _negatives(mining: Mining) -> Callable:
    k = mining.negatives

    def run(book, rows: _Side, code, bound, anchors: _Side):
        wanted = anchors.table["scores"].to_pylist()
        for at in range(0, len(anchors), AT_ONCE):
            a = slice(at, at + AT_ONCE)
            score = looked_up(anchors.x[a], code, book)
            norms = _norms(anchors.x[a])
            for j in range(score.shape[1]):
                n = at + j
                windows = [(s, *mining.window(s)) for s in wanted[n]]
                windows = [w for w in windows if w[1] <= w[2]]
                if not windows:
                    continue
                spread = bound * norms[j] + 1e-6
                low, high = score[:, j] - spread, score[:, j] + spread
                near = (high >= min(w[1] for w in windows)) & (low <= max(w[2] for w in windows))
                near = np.flatnonzero(near & (rows.label != anchors.label[n]))
                low, high = low[near], high[near]
                for positive, least, most in windows:
                    sure = low[(low >= least) & (high <= most)]
                    floor = max(least, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else least
                    i = near[(high >= floor) & (low <= most)]
                    exact = _exact(rows.x, anchors.x, i, np.full(len(i), n))
                    inside = (exact >= least) & (exact <= most)
                    i, exact = i[inside], exact[inside]
                    best = _first(np.zeros(len(i), np.int64), exact, rows.none[i], rows.id[i], k)
                    i = i[best]
                    same = np.full(len(i), positive, np.int64)
                    yield np.full(len(i), anchors.number[n]), same, exact[best], rows.id[i], rows.none[i]

    return run


def _coder(books: dict[int, np.ndarray], code: bool) -> Callable:
    """Vectors as bytes; with ``code``, their codes and residual norms too."""

    def run(batches):
        for batch in batches:
            x = batch["x"]
            widths, starts, values = x.value_lengths().to_numpy(), x.offsets.to_numpy()[:-1], x.values.to_numpy()
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                part = values[starts[at][:, None] + np.arange(width)].astype("<i4")
                same = [batch[c].take(pa.array(at)) for c in batch.schema.names if c != "x"]
                names = [c for c in batch.schema.names if c != "x"] + ["width", "x"]
                same += [pa.array(np.full(len(at), width, np.int32)), pa.array([v.tobytes() for v in part], pa.binary())]
                if code:
                    book = books.get(int(width))
                    if book is None:
                        book = np.zeros((STAGES, max(1, -(-int(width) // COMPONENTS)), CENTROIDS, COMPONENTS))
                    codes, bounds = encode(part, book)
                    same += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(bounds)]
                    names += ["code", "bound"]
                yield pa.RecordBatch.from_arrays(same, names)

    return run


def _meet(rows: DataFrame, anchors: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over each block of rows beside each block of anchors."""
    row_blocks = max(1, math.ceil(rows.count() / ROW_BLOCK))
    anchor_blocks = max(1, math.ceil(anchors.count() / ANCHOR_BLOCK))

    def dealt(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        number = F.pmod(row_hash("row_no", seed=5), F.lit(blocks)).cast("int")
        return side.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    key = ["width", "row_block", "anchor_block"]
    # blocks are few bytes and much work, so as many partitions as blocks as long as the session's number allows it
    parts = min(row_blocks * anchor_blocks, 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = dealt(rows, "row_block", row_blocks, "anchor_block", anchor_blocks).repartition(parts, *key)
    right = dealt(anchors, "anchor_block", anchor_blocks, "row_block", row_blocks).repartition(parts, *key)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def hard_negatives(rows: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``rows(id long, label, vector, anchor boolean)`` => anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the rows of its label with the highest scores, itself not among them; each gets the rows of other labels
    with the highest scores in its window. Ties go to the smaller id, null last. Rows without a label or vector, with a null or non-finite
    component, or with a norm of 2^31 or more after scaling (a score would be no long) take no part. Vectors are compared with those of their own
    width; one without components scores 0. Rows that repeat are rows of their own, as anchors, positives and negatives. An
    empty table gives no rows.
    """
    whole = materialize(integer_vectors(rows.select("id", F.col("label").cast("long").alias("label"), "vector", "anchor"), mining.scale), "integer-vectors")
    sample = whole.orderBy(row_hash("x"), "row_no").limit(SAMPLE).select("x").collect()
    by_width: dict[int, list] = {}
    for (x,) in sample:
        by_width.setdefault(len(x), []).append(x)
    books = {width: learn_codebooks(np.array(xs, np.float64).reshape(len(xs), width)) for width, xs in by_width.items()}
    # of equal vectors with one label no more can be in any result; partitions cut theirs before they move
    copies = Window.partitionBy("label", "x").orderBy(F.col("id").asc_nulls_last(), "row_no")
    most = max(mining.positives + 1, mining.negatives)
    kept = whole.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= most).select("row_no", "id", "label", "x")
    base = "row_no long, id long, label long, width int, x binary"
    coded = materialize(kept.mapInArrow(_coder(books, True), f"{base}, code binary, bound double"), "codes")
    anchors = materialize(whole.where("anchor").select("row_no", "id", "label", "x").mapInArrow(_coder(books, False), base), "anchors")

    def first(found: DataFrame, k: int, *key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.col("other").asc_nulls_last()))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    near = _meet(coded, anchors, _blocks(_positives(mining.positives), books, "number score other"), "number long, score long, other long")
    positives = materialize(first(near, mining.positives, "number").drop("rank"), "positives")
    asked = positives.groupBy(F.col("number").alias("row_no")).agg(F.collect_set("score").alias("scores"))
    asked = materialize(anchors.join(asked, "row_no"), "asked")
    names = "number positive_score score other"
    found = _meet(coded, asked, _blocks(_negatives(mining), books, names), ", ".join(f"{c} long" for c in names.split()))
    negatives = first(found, mining.negatives, "number", "positive_score")
    out = positives.withColumnsRenamed({"score": "positive_score", "other": "positive_id"}).join(negatives, ["number", "positive_score"])
    out = out.join(anchors.select(F.col("row_no").alias("number"), F.col("id").alias("anchor_id")), "number")
    return out.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def divisible(column: str, by: int) -> Column:
    return F.col(column) % by == 0


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(divisible("vec_id", 7), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(
        F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.col("embedding").alias("vector"),
        F.coalesce(divisible("vec_id", 50), F.lit(False)).alias("anchor"),
    )
    return hard_negatives(rows)


OP11_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), windows AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS place
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM windows WHERE place <= 3
"""

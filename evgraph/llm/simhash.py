"""SimHash near-duplicates, with candidate pairs from anchor points of a covering code.

Anchors are the words of the perfect Hamming code [31, 26] (covering radius 1), laid over
the low 31 bits of each half of a 64-bit fingerprint. Two fingerprints that differ in 3
bits or fewer differ in 1 bit or none in some half. There, each is sent to every anchor
within covering radius plus 1 = 2 (at most 16), and to its nearest anchor as its home;
the home of one is always among the anchors of the other. The other half, cut into one part more
than bits may differ, agrees in some part; so each anchor is divided by the bits of the parts, and fingerprints
alike in one half do not all meet. No link is lost, and each anchor's comparison is an
equi-join on anchor and part, verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evgraph.llm.common import boxed, lookup, materialize, read_table, row_hash
from evgraph.llm.components import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Shingles whose bits are counted at once; bounds the memory for long texts.
CHUNK = 1 << 16


def simhash64(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a text as an unsigned integer; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    width = min(width, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: n - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array(
            [digest(joined[i:j], 42) for i, j in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], np.uint64
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(simhash64, texts), np.uint64, len(texts)).view(np.int64))


def fingerprint(text: Column) -> Column:
    """64-bit SimHash of a text column, as a signed long."""
    return _fingerprint(text)


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 31-bit words: the index of a word and an anchor within distance 2 of it, pair by pair.

    The first pairs, one per word in order, hold its home, the nearest anchor.
    """
    syndrome = np.zeros(len(words), np.int64)
    for i in range(31):
        syndrome ^= ((words >> i) & 1) * (i + 1)
    index, near = [np.arange(len(words))], [np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)]
    off = np.flatnonzero(syndrome)
    for i in range(1, 32):  # flip bits i and j with i ^ j equal to the syndrome
        j = syndrome[off] ^ i
        take = j > i
        at = off[take]
        index.append(at)
        near.append(words[at] ^ (1 << (i - 1)) ^ (1 << (j[take] - 1)))
    return np.concatenate(index), np.concatenate(near)


def _parts(words: np.ndarray, n: int) -> list[np.ndarray]:
    """32-bit words cut into ``n`` parts."""
    cuts = [32 * i // n for i in range(n + 1)]
    return [(words >> low) & ((1 << (high - low)) - 1) for low, high in zip(cuts, cuts[1:])]


def _to_anchors(max_distance: int, home: bool) -> Callable:
    """Fingerprints => ``anchor``, ``rest`` (the bits of a part of the other half) and ``fp``, for homes only or for all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for half in (0, 1):
                index, near = _anchors((fps >> (32 * half)) & 0x7FFFFFFF)
                if home:
                    index, near = index[: len(fps)], near[: len(fps)]
                other = (fps >> (32 * (1 - half))) & 0xFFFFFFFF
                for i, part in enumerate(_parts(other, max_distance + 1)):
                    key = near | (half << 31) | (i << 32)
                    columns = [pa.array(key), pa.array(part[index]), pa.array(fps[index])]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "rest", "fp"])

    return run


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``fps(fp)`` of distinct longs => each pair ``(u, v)``, u < v, at ``max_distance`` (3 at most) bits or fewer.

    Spark sizes the homes and anchors by the rows that go in, but many come out of each; so neither side may be broadcast.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("the anchors cover distances of 3 bits at most")
    schema, fps = "anchor long, rest long, fp long", fps.select("fp")
    home = fps.mapInArrow(_to_anchors(max_distance, True), schema).withColumnRenamed("fp", "u")
    near = fps.mapInArrow(_to_anchors(max_distance, False), schema).withColumnRenamed("fp", "v")
    close = F.expr(f"u < v AND bit_count(u ^ v) <= {max_distance}")
    return home.join(near.hint("merge"), ["anchor", "rest"]).where(close).select("u", "v").distinct()


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``text_hash``, ``fp`` (signed long), ``component_id`` and ``root``.

    ``component_id`` is the smallest id whose fingerprint can be reached by links; ``root`` is the smallest such
    fingerprint, which tells components apart that share an id as name or have none. Rows of
    equal fingerprint are one node with a count, so groups of copies never pair up. Null,
    empty and wordless texts share fingerprint 0. Null ids get a component like any
    other row but never name one, unless all ids of it are null. Extra columns are ignored.
    """
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), row_hash(text).alias("text_hash"), fingerprint(text).alias("fp")
        ),
        "fingerprints",
    )
    count = F.count(F.lit(1))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), count.alias("copies")), "nodes")
    found = components(links(nodes)).withColumnRenamed("node", "fp")
    members = materialize(nodes.select("fp", "first_id").join(found, "fp"), "members")
    named = members.groupBy("root").agg(F.min("first_id").alias("component_id"), count.alias("n"))
    linked = lookup(members.select("fp", "root"), named, "root", "n", members.count())
    table = materialize(
        nodes.join(linked.select("fp", "component_id", "root"), "fp", "left").select(
            "fp", "copies", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root")
        ),
        "node-components",
    )
    found = lookup(rows, table, "fp", "copies", rows.count())
    return found.select(F.col("doc_id").alias(id_col), "text_hash", "fp", "component_id", "root")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with its smallest id.

    Null ids come last. Should rows of a group repeat that id, the text with the smallest hash stays, once. Groups
    count by their fingerprints, so those that share an id, or have none, each keep a row. Whatever the caller's
    columns are called, they come back as they were; an empty table gives an empty result.
    """
    key = ["none", "id", "hash"]
    parts = lambda doc_id, text_hash: {
        "none": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0).cast("long")), "hash": text_hash
    }
    first = F.min(F.struct(*[c.alias(n) for n, c in parts(F.col("doc_id"), F.col("text_hash")).items()]))
    kept = group_near_duplicates(docs).groupBy("root").agg(first.alias("first")).select("first.*")
    keyed = boxed(docs, **parts(F.col("doc_id").cast("long"), row_hash("text")))
    one = Window.partitionBy(*key).orderBy(*key)
    found = keyed.join(kept, key, "left_semi").select("row", F.row_number().over(one).alias("nth"))
    return found.where("nth = 1").select("row.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

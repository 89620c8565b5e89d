"""Token ids in ORC files: run-length coded integers in stripes, with row indexes and Bloom filters on document ids.

Documents are dealt by range of their ids and sorted; each task encodes its documents as they come, with a running count of
ids, and writes one file. Files follow each other in the order of the documents. A reader takes stripes in parallel, and the statistics of
stripes and row groups, and the Bloom filters, let it pass by what a search can't be in.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.byte_bpe import ByteBpe
from evgraph.llm.common import fresh_path, read_table, row_hash

END_ID = 2
#: Bytes of a stripe before it is written; rows of a row group; rate of false hits of a Bloom filter.
STRIPE_BYTES, GROUP_ROWS, FALSE_HITS = 32 << 20, 1000, 0.01
#: Ids of documents that a task holds before it hands them on.
HELD_IDS = 1 << 20

SCHEMA = "doc_id long, file int, before long, n_tokens long, ids array<int>"


def _encode(make_encoder: Callable, end_id: int) -> Callable:
    """Sorted (doc_id, text) => SCHEMA; ``before`` counts the ids of the documents before it in the task, whose number is the file's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, before = make_encoder(), TaskContext.get().partitionId(), 0
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            docs, start, held, n = batch.column(0), 0, [], 0
            for i, ids in enumerate(encoder.batch(batch.column(1))):
                held += [ids, end]
                n += len(ids)
                if i + 1 == batch.num_rows or n >= HELD_IDS:
                    sizes = np.array([len(x) + 1 for x in held[::2]], np.int64)
                    ends = before + np.cumsum(sizes)
                    lists = pa.ListArray.from_arrays((np.r_[before, ends] - before).astype(np.int32), np.concatenate(held).astype(np.int32))
                    columns = [docs.slice(start, len(sizes)), np.full(len(sizes), number, np.int32), ends - sizes, sizes, lists]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
                    start, held, n, before = i + 1, [], 0, int(ends[-1])

    end = np.array([end_id], np.uint32)
    return run


def write_tokens(docs: DataFrame, path: str, make_encoder: Callable = ByteBpe, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES) -> None:
    """ORC files at ``path`` with the ids of each document's whole text and ``end_id``, in ascending order of doc_id, null last.

    A null text counts as empty and has the end id only. Documents that share an id follow each other in the order of a hash of their
    texts. Only doc_id and text are read; an empty table gives files without rows.
    """
    none, doc_id = F.col("doc_id").isNull(), F.col("doc_id").cast("long")
    # rows alike in id and text are told apart by their number, so that many of them are no single task's
    keyed = docs.select(doc_id.alias("doc_id"), "text", none.alias("none"), row_hash("text").alias("hash"), F.monotonically_increasing_id().alias("row_no"))
    order = ["none", "doc_id", "hash", "row_no"]
    sorted_docs = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded = sorted_docs.mapInArrow(_encode(make_encoder, end_id), SCHEMA)
    options = {
        "compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.create.index": True, "orc.row.index.stride": GROUP_ROWS,
        "orc.rows.between.memory.checks": GROUP_ROWS, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_HITS,
    }
    encoded.write.options(**options).orc(path)


class TokenFiles:
    """A reader of what ``write_tokens`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.schema(SCHEMA).orc(path)

    def starts(self) -> DataFrame:
        """``file`` and ``file_start``, the ids of all files before it; one row for each file, from the narrow columns alone."""
        sizes = self.rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
        earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))

    def documents(self) -> DataFrame:
        """doc_id, ``start`` (the ids of all documents before it), n_tokens and ids of each document."""
        # one row for each file, which each took a task to write
        placed = self.rows.join(F.broadcast(self.starts()), "file")
        return placed.select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids")

    def find(self, *doc_ids: int) -> DataFrame:
        """The documents of these ids; stripes and row groups whose range or Bloom filter excludes them are not read."""
        wanted = self.rows.where(F.col("doc_id").isin(*doc_ids))
        return wanted.join(F.broadcast(self.starts()), "file").select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids")

    def window(self, start: int, length: int) -> DataFrame:
        """The pieces of documents that hold the ids from ``start`` on, ``length`` of them: doc_id, start and ids."""
        first = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
        last = F.least(F.lit(start + length) - F.col("start"), F.col("n_tokens"))
        inside = self.documents().where((F.col("start") < start + length) & (F.col("start") + F.col("n_tokens") > start))
        piece = F.slice("ids", (first + 1).cast("int"), (last - first).cast("int"))
        return inside.select("doc_id", (F.col("start") + first).alias("start"), piece.alias("ids"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        values, offsets = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return TokenFiles(spark, path).documents().mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Packing token sequences: first-fit decreasing in randomised groups of documents.

Documents are dealt to groups of bounded size by a seeded hash. A document's tokens are
cut into full sequences and a rest; the rests of a group are placed, longest first, each
into the first bin with room, found in a tournament tree of the bins' free space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm.byte_bpe import ByteBpe
from evgraph.llm.common import deal, number_copies, read_table

SEQUENCE_TOKENS = 1024
END_ID = 0
#: Bytes of text that make a group.
GROUP_BYTES = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class FreeSpace:
    """Tournament tree over bins: each node holds the most free space below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def take(self, amount: int) -> tuple[int, int]:
        """Place ``amount`` in the first bin with room: its number and what it held before."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < amount:
                at += 1
        free = tree[at]
        number = at - self.leaves
        tree[at] = free - amount
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return number, free


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset for each length; equal lengths keep their order."""
    free, out = FreeSpace(len(lengths), capacity), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        number, room = free.take(lengths[i])
        out[i] = (number, capacity - room)
    return out


def _pack_groups(capacity: int, make_encoder: Callable) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        group, used, rests, out, held = None, 0, [], [], 0

        def close_group() -> None:
            nonlocal used, rests
            places = first_fit_decreasing([len(ids) for *_, ids in rests], capacity)
            for (doc_id, start, total, ids), (number, offset) in zip(rests, places):
                out.append((doc_id, start, len(ids), ids.tobytes(), total, (group << 32) + used + number, offset))
            used, rests = 0, []

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            columns = list(zip(*out)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            out, held = [], 0
            return batch

        for batch in batches:
            for number, doc_id, ids in zip(batch.column(0), batch.column(1), encoder.batch(batch.column(2))):
                if number.as_py() != group:
                    if group is not None:
                        close_group()
                    group = number.as_py()
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                doc, total, whole = doc_id.as_py(), len(ids), len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    out.append((doc, start, capacity, ids[start : start + capacity].tobytes(), total, (group << 32) + used, 0))
                    used += 1
                if whole < total:
                    rests.append((doc, whole, total, ids[whole:].copy()))
                held += total
                if held > 2_000_000:
                    yield flush()
        if group is not None:
            close_group()
        yield flush()

    return pack


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS,
    group_bytes: int = GROUP_BYTES, seed: int = 11, make_encoder: Callable = ByteBpe,
) -> DataFrame:
    """One row per piece: ``SCHEMA``, where ``ids`` are little-endian unsigned 32-bit ids.

    Each document is its ids and then ``END_ID``; a null or empty text is that id alone. No
    sequence holds more than ``capacity`` ids, and each id lies in exactly one piece. Rows
    that repeat are packed each for itself, and many copies of a row spread over all groups. Sequence ids are unique, not consecutive. An
    empty table gives no pieces. Extra columns are ignored. Groups are fixed by the rows, not by
    partitions, and rows have a fixed order in them, so that a task that is run again gives the same result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1)).first()[0] or 0
    keyed = number_copies(rows, seed).select("row.*", "draw", F.pmod("draw", F.lit(size // group_bytes + 1)).alias("group"))
    dealt = deal(keyed, size, "group").sortWithinPartitions("group", "draw", "doc_id").select("group", "doc_id", "text")
    return dealt.mapInArrow(_pack_groups(capacity, make_encoder), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

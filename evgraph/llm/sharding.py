"""Two-pass external shuffle of records into shards (DataFrame functions only).

Pass one scatters records over buckets that fit in memory, by seeded hashes; a bucket
belongs to one shard. Pass two reads each bucket into an array and permutes it with a Fisher-Yates
shuffle whose draws are seeded by shard, bucket and step. A record's slot is its place in the
permuted bucket behind all earlier buckets of its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm.common import deal, free_name, in_order, number_copies, read_table, row_hash

LAW = "key"
#: Bytes and records that make a bucket, on average; whichever comes first.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 256


def shard_of(id_col: Column, shards: int, seed: int = 0) -> Column:
    """Rendezvous hashing: the shard whose hash with the id is the largest.

    One more shard takes ids only into itself, since the order among the others stays.
    """
    draws = [F.struct(row_hash(id_col, F.lit(i), seed=seed).alias("draw"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.greatest(*draws)["shard"] if shards > 1 else F.lit(0)


def fisher_yates(items: Column, *key: Column, seed: int = 0) -> Column:
    """``items`` permuted: from the last place down, each item swaps with one at or before it, drawn by hash of key and place."""

    def swap(a: Column, place: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit(seed), *key, place), place.cast("long") + 1).cast("int")
        between = F.slice(a, other + 2, place - other - 1)
        swapped = F.concat(
            F.slice(a, F.lit(1), other), F.slice(a, place + 1, F.lit(1)), between, F.slice(a, other + 1, F.lit(1)),
            F.slice(a, place + 2, F.size(a)),
        )
        return F.when(other == place, a).otherwise(swapped)

    # places move, not records
    none = F.array().cast("array<int>")
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(none)
    steps = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))).otherwise(none)
    return F.transform(F.aggregate(steps, places, swap), lambda at: F.get(items, at))


def shard(
    records: DataFrame, shards: int, id_col: str = "doc_id", size: Column | None = None,
    bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, seed: int = 0,
) -> DataFrame:
    """All columns of ``records``, then ``_shard`` and ``_slot`` (gapless from 0 in each shard).

    Should ``records`` have columns of these names, the new ones get underscores behind theirs. The shard follows from
    the id and the number of shards alone; null ids are one id. Buckets are dealt by a hash of the whole
    record, and copies of a record are numbered, so that they spread evenly too. Rows alike in all columns are
    interchangeable; beyond that the slots follow from the records and the seed, not from partitions. ``size`` is a record's
    bytes (of column ``text``, if not given). An empty table gives an empty result.
    """
    if size is None:
        size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    total, rows = records.agg(F.sum(size), F.count(F.lit(1))).first()
    buckets = max(1, -(-(total or 0) // (bucket_bytes * shards)), -(-rows // (bucket_rows * shards)))
    key = ["shard", "bucket"]
    keyed = number_copies(records, seed).select(
        "row", "draw", shard_of(F.col("row")[id_col], shards, seed).alias("shard"),
        F.pmod("draw", F.lit(buckets)).alias("bucket"),
    )
    counts = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    behind = in_order(counts, *key, sums=("n",))
    # one row for each shard
    starts = behind.groupBy("shard").agg(F.min("before_n").alias("start"))
    offsets = behind.join(F.broadcast(starts), "shard").select(*key, (F.col("before_n") - F.col("start")).alias("before"))
    scattered = deal(keyed, total or 0, *key)
    loaded = scattered.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("draw", "row"))).alias("items"))
    permuted = loaded.select(*key, fisher_yates(F.col("items"), *map(F.col, key), seed=seed).alias("items"))
    placed = permuted.join(offsets.hint("shuffle_hash"), key).select("shard", "before", F.posexplode("items").alias("place", "item"))
    return placed.select(
        "item.row.*", F.col("shard").alias(free_name(records, "_shard")),
        (F.col("before") + F.col("place")).alias(free_name(records, "_slot")),
    )


def write_shards(sharded: DataFrame, path: str, shard_col: str = "_shard", slot_col: str = "_slot") -> None:
    """Write the result of ``shard`` as Parquet, a folder for each shard; each file's rows are in the order of their slots."""
    sharded.sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    sharded = shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shards)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit(LAW).alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )

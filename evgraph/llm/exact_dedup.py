"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a table of digests, bucketed and sorted by digest. A batch is reduced to one
row per digest, a sort-merge anti-join finds the digests that the index lacks, and these
are appended. The index side of both joins is read bucket by bucket, without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.common import WS, boxed, fresh_path, lookup, materialize, note, read_table

#: Digests of the first batch that make a bucket, and the fewest buckets.
BUCKET_DIGESTS = 4 << 20
MIN_BUCKETS = 8


def normalized(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


class DigestIndex:
    """Digests seen so far, kept at ``path``; a later session opens the same path again.

    The number of buckets stays as it was fixed: by ``buckets``, else by the size of the first batch. Give it
    for an index that will outgrow its first batch by far.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path, note(spark, path, "buckets")
        self.table = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        if self.buckets or buckets:
            self._open(self.buckets or buckets)

    def _open(self, buckets: int) -> None:
        self.buckets = note(self.spark, self.path, "buckets", buckets)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, first_id BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def prepare(self, digests: int) -> None:
        """Fix the number of buckets for a first batch of so many digests."""
        if not self.buckets:
            self._open(max(MIN_BUCKETS, -(-digests // BUCKET_DIGESTS)))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def entered(self) -> DataFrame:
        """One row per digest: ``first_id`` and ``batch``. Two writers at once can both enter a digest; then the lesser batch counts."""
        first = F.min(F.struct("batch", F.col("first_id").isNull().alias("none"), "first_id")).alias("entry")
        return self.read().groupBy("digest").agg(first).select("digest", "entry.first_id", "entry.batch")

    def missing(self, groups: DataFrame) -> DataFrame:
        return groups.join(self.read().hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        (
            rows.select("digest", "first_id", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def deduplicate(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """Enter a batch into ``index`` and return one row per input row.

    Columns: the id, ``digest`` (binary SHA-256 of the normalised text), ``keep_id``,
    ``group_size`` (equal texts in this batch) and ``kept``. Of equal texts in a batch the row with
    the smallest id stays (null ids last; of rows alike in id too, one); a text that an
    earlier batch entered keeps that batch's id, and no row of this batch stays. ``batch`` names the batch: a call
    repeated under its name after a failure, with the same rows, enters nothing twice and keeps the same rows; without a
    name each call is a batch of its own. Null and empty texts are equal. An empty batch gives an empty
    result. Extra columns are ignored.
    """
    batch = batch or uuid.uuid4().hex
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(text_sha256(F.col(text_col))).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first")
    groups = materialize(
        rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size")).select(
            "digest", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), "group_size"
        ),
        "digest-groups",
    )
    index.prepare(groups.count())
    index.append(index.missing(groups), batch)
    known = index.entered().withColumnRenamed("first_id", "keep_id").hint("merge")
    groups = groups.drop("first_id").join(known, "digest")
    found = lookup(rows, groups, "digest", "group_size", rows.count())
    return found.select(
        F.col("doc_id").alias(id_col), "digest", "keep_id", "group_size",
        ((F.col("batch") == batch) & (F.col("row") == F.col("first_row"))).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with all their columns, whatever these are called.

    The join is by digest and id, so that copies spread over all tasks.
    """
    key = lambda c: [c.isNull().alias("none"), F.coalesce(c, F.lit(0).cast("long")).alias("id")]
    names = ["digest", "none", "id"]
    kept = deduplicate(docs, index, batch=batch).where("kept").select("digest", *key(F.col("doc_id")))
    none, number = key(F.col("doc_id").cast("long"))
    keyed = boxed(docs, digest=F.unhex(text_sha256(F.col("text"))), none=none, id=number)
    one = Window.partitionBy(*names).orderBy(*names)
    found = keyed.join(kept, names, "left_semi").select("row", F.row_number().over(one).alias("nth"))
    return found.where("nth = 1").select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    found = deduplicate(read_table(spark, sf_dir, "documents"), index)
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

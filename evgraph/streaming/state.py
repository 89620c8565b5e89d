"""A change log with keyed state: each micro-batch reads and writes the rows that it changes, not the table.

The state store holds the current row of each key, and Spark keeps it beside the checkpoint. What a batch changes is a small table of its own;
the current table is the latest of these for each key. ``compact`` folds them into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evgraph.plans.shared import hadoop_path


class KeyedStream:
    """The state of a log in the folder ``home``; a later one with the same folder goes on where it ended, also after a failure.

    ``key`` names rows, ``ordinal`` orders the changes of a key and is different for any two of them. ``first`` columns keep the value of the first change, all others
    take that of the last; with ``merge`` a null leaves the value that was there. ``deleted`` is a condition on a row that ends the key: it is no row of the table until
    a later change brings it back, with the values of its first change.
    """

    def __init__(
        self, spark: SparkSession, home: str, schema: str | StructType, key: str, ordinal: str, first: tuple[str, ...] = (),
        merge: bool = False, deleted: Column | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.home, self.schema, self.key, self.ordinal = spark, home.rstrip("/"), schema, key, ordinal
        self.first, self.merge, self.deleted, self.prepare = first, merge, deleted, prepare or (lambda df: df)

    def current_rows(self, changes: DataFrame) -> DataFrame:
        """The row of each key after all of ``changes``; as an aggregate it works on a stream, with its buffers as state, and on a table."""
        rest = [c for c in changes.columns if c not in (self.key, self.ordinal)]
        aggregates = [F.max(self.ordinal).alias(self.ordinal)]
        for c in rest:
            if c in self.first:
                aggregates.append(F.min_by(c, self.ordinal).alias(c))
            elif self.merge:
                # a null change has no ordinal here, and none but nulls gives null
                aggregates.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(self.ordinal))).alias(c))
            else:
                aggregates.append(F.max_by(c, self.ordinal).alias(c))
        return changes.groupBy(self.key).agg(*aggregates).select(*changes.columns)

    def _folders(self, kind: str) -> list[tuple[int, str]]:
        folder, fs = hadoop_path(self.spark, self.home)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [n for n in names if n.startswith(f"{kind}-") and fs.exists(hadoop_path(self.spark, f"{self.home}/{n}/_SUCCESS")[0])]
        return sorted((int(n.rpartition("-")[2]), f"{self.home}/{n}") for n in whole)

    def advance(self, log: str, files_per_batch: int = 1) -> None:
        """Take in what the log's folder holds now and was not taken in before."""

        def write(changed: DataFrame, number: int) -> None:
            # a batch that is run again replaces what it wrote
            changed.write.mode("overwrite").parquet(f"{self.home}/changes-{number}")

        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
        rows = self.current_rows(self.prepare(stream))
        query = (
            rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def changes(self) -> DataFrame | None:
        """What each batch since the last ``compact`` changed, with its ``batch``."""
        base = self._folders("base")
        newer = [(n, path) for n, path in self._folders("changes") if not base or n > base[-1][0]]
        parts = [self.spark.read.parquet(path).withColumn("batch", F.lit(n).cast("long")) for n, path in newer]
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def table(self) -> DataFrame:
        """The current row of each key: a key's changes hide older rows, and only changes are dealt by key."""
        base, changes = self._folders("base"), self.changes()
        stored = self.spark.read.parquet(base[-1][1]) if base else None
        if changes is not None:
            rest = [c for c in changes.columns if c not in (self.key, "batch")]
            latest = changes.groupBy(self.key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(self.key, "row.*")
            columns = [c for c in changes.columns if c != "batch"]
            latest = latest.select(*columns)
            stored = latest if stored is None else stored.join(latest.select(self.key), self.key, "left_anti").select(*columns).unionByName(latest)
        if stored is None:
            stored = self.current_rows(self.prepare(self.spark.createDataFrame([], self.schema)))
        return stored if self.deleted is None else stored.where(~F.coalesce(self.deleted, F.lit(False)))

    def compact(self) -> None:
        """Fold all changes into one table, deleted keys too, since a later change may bring them back. A reader sees the one or the other."""
        newer = self._folders("changes")
        base = self._folders("base")
        if newer and (not base or newer[-1][0] > base[-1][0]):
            whole = KeyedStream(self.spark, self.home, self.schema, self.key, self.ordinal, self.first, self.merge, None, self.prepare)
            whole.table().write.mode("overwrite").parquet(f"{self.home}/base-{newer[-1][0]}")

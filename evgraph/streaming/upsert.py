"""A change log as a stream: each micro-batch is merged into a snapshot, the last change by ordinal wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.plans.shared import fresh_path, hadoop_path


def latest(changes: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row of each key with the greatest ordinal, not the one that came last."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("row")).select(key, "row.*")


def follow(
    spark: SparkSession, log_dir: str, schema: str, prepare: Callable[[DataFrame], DataFrame], key: str, ordinal: str,
    files_per_batch: int = 1, home: str | None = None,
) -> DataFrame:
    """Read what the log holds now as a stream and return the snapshot after it.

    ``home`` is a folder for snapshots and checkpoint: a later call with the same one goes on where the last one ended, also after
    a failure; without one they live as long as the session. Snapshots are immutable tables; a micro-batch
    reads that of the batch before and writes its own, so that a batch that is run again writes the same table.
    """
    home = home or fresh_path(spark, "stream")

    def last_snapshot(before: int | None = None) -> str | None:
        folder, fs = hadoop_path(spark, home)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-")]
        numbers = [n for n in numbers if before is None or n < before]
        return f"{home}/snapshot-{max(numbers)}" if numbers else None

    def merge(batch: DataFrame, number: int) -> None:
        fresh, stored = prepare(batch), last_snapshot(number)
        if stored:
            fresh = spark.read.parquet(stored).unionByName(fresh)
        latest(fresh, key, ordinal).write.mode("overwrite").parquet(f"{home}/snapshot-{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    stored = last_snapshot()
    return spark.read.parquet(stored) if stored else prepare(spark.createDataFrame([], schema))

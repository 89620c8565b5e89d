"""Tables in the folder that the driver and all executors share; they end a plan's lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as ``spark.checkpoint.dir`` names it.

    Only a session in local mode may lack the setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='evgraph-')}")
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/evgraph-{name}-{uuid.uuid4().hex}"
    p, fs = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


#: With this setting Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as each is done; the session's own setting comes back."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    so a lost executor costs a reread and not a recomputation. What was shuffled for it goes at once.

    Spark takes a file's size for that of its rows; so a stronger ``codec`` is for tables that no join may broadcast.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.plans.shared import fresh_path, hadoop_path

__all__ = [
    "HOT_SHARE", "WORD", "WS", "boxed", "deal", "free_name", "fresh_path", "in_order", "lookup", "materialize", "note",
    "number_copies", "read_table", "row_hash",
]

#: One or more ASCII white-space characters; what lies between them is a word.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds at least one row in so many; so many keys are hot at most.
HOT_SHARE = 1000
#: Rows alike in all columns are numbered if there are more of them; so many copies are made by one task at once.
COPIES, COPY_BLOCK = 64, 1 << 16
#: Bytes of rows that ``deal`` gives to one task at most, on average.
TASK_BYTES = 256 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; shuffle files stay for what else runs on ``df``."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note(spark: SparkSession, path: str, name: str, value: int | None = None) -> int | None:
    """A number kept with the table at ``path``, as the name of a folder that readers of the table pass over; sets or finds it."""
    p, fs = hadoop_path(spark, path)
    if value is not None:
        fs.mkdirs(hadoop_path(spark, f"{path}/_{name}_{value}")[0])
        return value
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return next((int(x.rpartition("_")[2]) for x in names if x.startswith(f"_{name}_")), None)


def deal(rows: DataFrame, size: int, *key: str) -> DataFrame:
    """Rows of ``size`` bytes in all, those of a key together, in as many partitions as the session has for shuffles.

    Should these not do for so many bytes, there are more.
    """
    n = -(-size // TASK_BYTES)
    enough = n <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(*key) if enough else rows.repartition(n, *key)


def lookup(rows: DataFrame, table: DataFrame, key: str, counts: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key, ``counts`` rows of ``rows`` each).

    ``total`` is the number of rows that the counts add up to. Keys that hold at least one
    row in HOT_SHARE number HOT_SHARE at most, whatever the input: these are broadcast, and
    their rows never move. All others go through a shuffled join.
    """
    is_hot = F.col(counts) * F.lit(HOT_SHARE) >= F.lit(int(total))
    hot = F.broadcast(table.where(is_hot))
    rest = table.where(~is_hot)
    return rows.join(hot, key).unionByName(
        rows.join(hot.select(key), key, "left_anti").join(rest, key)
    )


def row_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A seeded 64-bit hash of columns; nulls count as a value of their own."""
    parts = [F.lit(seed)]
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def boxed(rows: DataFrame, **derived: Column) -> DataFrame:
    """The caller's columns as one struct ``row``, with ``derived`` beside it, so that no name of theirs can clash."""
    return rows.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in derived.items()])


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, or with as many underscores behind it as it takes to be no column of ``rows``."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_copies(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``row`` (the caller's columns) and ``draw``, a seeded hash of the row and its number among its copies.

    Up to COPIES rows alike in all columns share one hash. Where there are more, they are counted before
    anything moves, one of them stands for all, and so many are made again from it, each with a number and a
    hash of its own: copies spread over all groups that are dealt by ``draw``, and since rows alike
    are interchangeable, how many come to each group follows from the table alone.
    """
    columns = [F.to_json(F.struct(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in rows.dtypes]
    hashed = boxed(rows, h1=row_hash(*columns, seed=seed), h2=row_hash(*columns, seed=seed + 1))
    key = ["h1", "h2"]
    again = hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES)
    again = materialize(again, "copies")
    if again.isEmpty():
        return hashed.select("row", F.col("h1").alias("draw"))
    once = hashed.join(again, key).groupBy(*key).agg(F.first("row").alias("row"), F.first("n").alias("n"))
    blocks = once.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPY_BLOCK).cast("long"))).alias("at"))
    last = F.least(F.col("at") + COPY_BLOCK, F.col("n")) - 1
    made = blocks.repartition("h1", "at").select("row", F.col("h1"), F.explode(F.sequence("at", last)).alias("number"))
    # a table of their own, since fields of a struct that are taken above two explodes make an invalid plan in Spark 4.1
    made = materialize(made.select("row", F.xxhash64(F.lit(seed), "h1", "number").alias("draw")), "numbered-copies")
    rest = hashed.join(again, key, "left_anti").select("row", F.col("h1").alias("draw"))
    return rest.unionByName(made)


def in_order(rows: DataFrame, *columns: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows``, which ``columns`` tell apart, with ``rank`` (from 1) in their order over all partitions.

    For each of ``sums``, ``before_<name>`` is its sum over all earlier rows. Each range partition is
    numbered by itself; the totals of the partitions before it, one row for each, are added.
    """
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"of_{c}") for c in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the exchange above, whatever the number of rows
    offsets = totals.select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        *[F.coalesce(F.sum(f"of_{c}").over(earlier), F.lit(0)).alias(f"parts_{c}") for c in sums],
    )
    inside = Window.partitionBy("part").orderBy(*columns)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "part").select(
        *rows.columns, (F.col("rows_before") + F.row_number().over(inside)).alias("rank"),
        *[(F.col(f"parts_{c}") + F.coalesce(F.sum(c).over(so_far), F.lit(0))).alias(f"before_{c}") for c in sums],
    )

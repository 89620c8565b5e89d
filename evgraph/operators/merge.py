"""Upserts, removals and merges of nodes and edges: joins of a stored snapshot with a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions.columns import quoted


def last_of_batch(batch: DataFrame, order: str) -> DataFrame:
    """One row per id: the last one by ``order``, with the first one's ``first_seen_rev``."""
    columns = [c for c in batch.columns if c != order]
    picked = batch.groupBy("id").agg(
        F.max_by(F.struct(*columns), order).alias("row"), F.min_by("first_seen_rev", order).alias("first")
    )
    return picked.select("row.*", "first").withColumn("first_seen_rev", F.col("first")).drop("first")


def upsert(stored: DataFrame, batch: DataFrame, rev: str | None = None, order: str = "ordinal", mode: str = "replace") -> DataFrame:
    """``stored`` with ``batch`` merged in by id.

    A stored ``first_seen_rev`` stays. ``rev``, if given, is the last (and observed) revision of all
    rows of the batch, and the first of new ones that bring none. ``replace`` overwrites all
    other columns, absent ones with null; ``merge`` keeps the stored value where the batch has null.
    ``order`` is a column of ``batch``: of rows with one id the last one counts.
    """
    fresh = last_of_batch(batch, order)
    given = F.lit(rev)
    fresh = fresh.withColumn("first_seen_rev", F.coalesce("first_seen_rev", given))
    fresh = fresh.withColumn("last_seen_rev", F.coalesce(given, "last_seen_rev", "first_seen_rev"))
    if "observed_in_rev" in fresh.columns:
        fresh = fresh.withColumn("observed_in_rev", F.coalesce(given, "observed_in_rev", "first_seen_rev"))
        own = F.col("evidence")
        fresh = fresh.withColumn("evidence", own.withField("rev", F.coalesce(own["rev"], F.col("observed_in_rev"))))
    old, new = stored.alias("old"), fresh.withColumn("_new", F.lit(True)).alias("new")
    is_new = F.col("new._new").isNotNull()

    def pick(c: str) -> Column:
        if c == "id":
            return F.coalesce("new.id", "old.id").alias(c)
        if c == "first_seen_rev":
            return F.coalesce(f"old.{c}", f"new.{c}").alias(c)
        if mode == "merge":
            return F.coalesce(f"new.{c}", f"old.{c}").alias(c)
        return F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return old.join(new, F.col("old.id") == F.col("new.id"), "full_outer").select(*[pick(c) for c in stored.columns])


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, cascade: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``ids(id)``; with ``cascade`` also edges without those that touch them."""
    gone = ids.select(F.col("id").alias("_gone"))
    kept = nodes.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    if cascade:
        for end in ("src", "dst"):
            edges = edges.join(gone, F.col(end) == F.col("_gone"), "left_anti")
    return kept, edges


def remove_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    for end in ("src", "dst"):
        there = nodes.select(F.col("id").alias(f"_{end}")).distinct()
        edges = edges.join(there, F.col(end) == F.col(f"_{end}"), "left")
    return edges.where("_src IS NULL OR _dst IS NULL").drop("_src", "_dst")


def record_revision(revisions: DataFrame, sha: str | None, parent: str | None = None, at: str | None = None, summary: str | None = None) -> DataFrame:
    """History with a revision entered; one known before keeps its place, a blank one changes nothing. Empty fields are absent ones."""
    if not sha or not sha.strip():
        return revisions
    spark = revisions.sparkSession
    new = spark.createDataFrame([(sha.strip(), parent or None, at or None, summary or None)], "sha string, parent string, at string, summary string")
    last = revisions.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("last"))
    known = revisions.where(F.col("sha") == sha.strip()).agg(F.min("ordinal").alias("known"))
    # both sides are one row
    new = new.join(last, F.lit(True)).join(known, F.lit(True))
    new = new.select("sha", "parent", "at", "summary", F.coalesce("known", F.col("last") + 1).alias("ordinal"))
    return revisions.where(F.col("sha") != sha.strip()).unionByName(new)


def last_revision(revisions: DataFrame) -> DataFrame:
    return revisions.agg(F.max_by("sha", "ordinal").alias("sha"))


def dedupe_evidence(pieces: Column) -> Column:
    """The first of pieces with the same file and line, in order."""
    key = lambda e: F.struct(e["file"], e["line_start"])
    keys = F.transform(pieces, key)
    return F.filter(pieces, lambda e, i: F.array_position(keys, key(e)) == i + 1)


def primary_location(pieces: Column) -> Column:
    """The earliest piece by file and line."""
    return F.array_min(F.transform(pieces, lambda e: F.struct(e["file"].alias("file"), e["line_start"].alias("line_start"), e["line_end"].alias("line_end"))))


def merge_nodes(nodes: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row per id: the first row's columns, and the union of all evidence by file and line.

    Pieces are reduced to one for each place before they are gathered.
    """
    scalars = [c for c in nodes.columns if c not in ("evidence", order)]
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*scalars), order).alias("row"))
    pieces = nodes.select("id", order, F.posexplode("evidence").alias("at", "e"))
    pieces = pieces.groupBy("id", F.col("e.file").alias("file"), F.col("e.line_start").alias("line")).agg(
        F.min(F.struct(order, "at", "e")).alias("piece")
    )
    evidence = pieces.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["e"]).alias("evidence")
    )
    joined = first.withColumnRenamed("id", "_id").join(evidence.withColumnRenamed("id", "_eid"), F.col("_id") == F.col("_eid"), "left")
    return joined.select("row.*", "evidence").select(*[c for c in nodes.columns if c != order])


def canonical_order(rows: DataFrame) -> DataFrame:
    """Rows in the order of their quoted ids, where a name sorts behind names that go on with a space."""
    return rows.orderBy(quoted(F.col("id")))

"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight that fixes its share of the words, and a schedule, linear in
training time, that says when they come. The integral of a source's schedule is its
cumulative demand; its documents lie end to end in a seeded order, and a document's place
on that line, put into the inverse of the demand, gives its time. The demand of all sources
up to that time is its position in tokens, and documents are ranged by position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.common import WORD, WS, free_name, in_order, materialize, number_copies, read_table


@dataclass(frozen=True)
class Curriculum:
    """``weights`` and ``ramps`` repeat over the sources in code point order, null last.

    A ramp is a weight's factor at the start and at the end of training, both above 0.
    ``max_epochs`` bounds a source's target to so many times its size. ``cell_rows`` is the
    number of rows that are put in order together, ``task_words`` that of the words that
    the final ranging gives to one task.
    """

    weights: tuple[float, ...] = (5, 2, 1)
    ramps: tuple[tuple[float, float], ...] = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
    max_epochs: int = 3
    seed: int = 7
    cell_rows: int = 20_000
    task_words: int = 4_000_000


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycled(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values) + 1).cast("int"))


def source_targets(cells: DataFrame, curriculum: Curriculum = Curriculum()) -> tuple[DataFrame, float, float]:
    """``cells(key, source, size)`` => one row per source with its size, target and schedule, and the mix's linear and square demand.

    Targets share the total by weight, but stop at ``max_epochs`` times the source's size;
    the level to which the others then rise has a closed form over the sources by their
    ratio of bound to weight. Both orders, by name and by ratio, run over all partitions, so sources may be
    as many as hosts; a few sums reach the driver.
    """
    sources = cells.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    named = in_order(sources.withColumn("none", F.col("source").isNull()), "none", "source")
    at = F.col("rank") - 1
    named = (
        named.withColumn("weight", _cycled(curriculum.weights, at))
        .withColumn("ramp_from", _cycled(tuple(a for a, _ in curriculum.ramps), at))
        .withColumn("ramp_to", _cycled(tuple(b for _, b in curriculum.ramps), at))
        .withColumn("bound", F.col("source_size") * curriculum.max_epochs)
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .drop("rank")
    )
    filling = in_order(named, "ratio", "none", "source", sums=("bound", "weight"))
    words, weights = filling.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(words or 0) - F.col("before_bound")) / (F.lit(float(weights or 1)) - F.col("before_weight"))
    fits = F.min(F.when(level <= F.col("ratio"), F.struct("rank", level.alias("level"))))
    found = filling.agg(fits.alias("found"), F.max("ratio").alias("last")).first()
    reached = (found["found"]["level"] if found["found"] else found["last"]) or 0.0
    target = F.least(F.col("bound").cast("double"), F.col("weight") * F.lit(float(reached)))
    filling = filling.withColumn("target", target)
    mean = (F.col("ramp_from") + F.col("ramp_to")) / 2
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")  # noqa: E731  # sums that no order of rows changes
    linear, square = filling.agg(
        exact(F.col("target") * F.col("ramp_from") / mean),
        exact(F.col("target") * (F.col("ramp_to") - F.col("ramp_from")) / 2 / mean),
    ).first()
    return filling.select("key", "source_size", "target", "ramp_from", "ramp_to"), linear or 0.0, square or 0.0


def plan_mix(docs: DataFrame, size: Callable[[Column], Column], order_by: list[str], curriculum: Curriculum = Curriculum()) -> DataFrame:
    """``row`` (the caller's columns), ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` gives the words of a row. ``copies`` has the ``position`` in training, in tokens, and the ``words`` of each copy that
    the mix takes, at most ``max_epochs``; it is empty for documents that are left out. Copies
    are whole but for the one of each source that crosses its target, which ends there. ``order_by``
    names the columns that tell rows apart; rows alike in them are interchangeable. A source
    without words has target 0, documents without words are never taken, and a null source
    is a source like others. An empty table gives an empty result. A source's documents
    are dealt to cells by a seeded hash, many copies of a row by a hash for each, so that no source is put in order by one task.
    """
    key, n = ["key", "cell"], docs.count() // curriculum.cell_rows + 1
    source = F.col("row")["source"]
    keyed = number_copies(docs, curriculum.seed).select(
        "row", "draw", size(F.col("row")).alias("size"), source.alias("source"),
        F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)).alias("key"), F.pmod("draw", F.lit(n)).alias("cell"),
    )
    cells = materialize(keyed.groupBy(*key).agg(F.min("source").alias("source"), F.sum("size").alias("size")), "mix-cells")
    offsets = in_order(cells.select(*key, "size"), *key, sums=("size",))
    firsts = offsets.groupBy("key").agg(F.min("before_size").alias("first"))
    targets, linear, square = source_targets(cells, curriculum)
    offsets = offsets.join(firsts, "key").join(targets, "key").withColumn("before", F.col("before_size") - F.col("first"))
    offsets = materialize(offsets.drop("size", "rank", "before_size", "first"), "mix-offsets")
    inside = Window.partitionBy(*key).orderBy("draw", *[F.col("row")[c] for c in order_by]).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(inside) - F.col("size")
    placed = keyed.drop("source").join(offsets.hint("shuffle_hash"), key).withColumn("start", start)
    epochs = F.sequence(F.lit(0), F.lit(curriculum.max_epochs - 1))
    rise = F.col("ramp_to") - F.col("ramp_from")

    def position(at: Column) -> Column:
        demand = at / F.col("target") * (F.col("ramp_from") + F.col("ramp_to"))
        time = demand / (F.col("ramp_from") + F.sqrt(F.col("ramp_from") * F.col("ramp_from") + rise * demand))
        return F.lit(linear) * time + F.lit(square) * time * time

    copies = F.transform(epochs, lambda e: e * F.col("source_size") + F.col("start"))
    copies = F.transform(
        F.filter(copies, lambda at: (F.col("size") > 0) & (F.round("target") > at)),
        lambda at: F.struct(
            position(at).alias("position"),
            F.least("size", F.round("target").cast("long") - at).alias("words"),
        ),
    )
    return placed.select("row", "size", "source_size", "target", copies.alias("copies"))


def range_sort(rows: DataFrame, position: Column, total_words: int, curriculum: Curriculum = Curriculum()) -> DataFrame:
    """Rows in the order of ``position`` over all partitions; null positions come last.

    Demand makes words dense evenly over positions, so equal ranges of them are equal shares of work
    and no sample of the rows is needed to set the bounds. Rows of equal position have no order among them.
    """
    n = total_words // curriculum.task_words + 1
    part = F.least((position / F.lit(total_words + 1.0) * n).cast("int"), F.lit(n - 1))
    # rows that are left out hold no words in the mix; they are spread over all tasks, behind the rest
    part = F.coalesce(part, F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(n)).cast("int"))
    return rows.repartitionById(n, part).sortWithinPartitions(position.asc_nulls_last())


def first_words(text: Column, words: Column) -> Column:
    """The first words of a text, joined by single spaces."""
    return F.array_join(F.slice(F.filter(F.split(text, WS), lambda w: w != ""), F.lit(1), words.cast("int")), " ")


def mix(docs: DataFrame, text_col: str = "text", curriculum: Curriculum = Curriculum()) -> DataFrame:
    """The training stream: the columns of ``docs``, one row per copy taken, and ``position``, which it is ranged by.

    Should ``docs`` have a column ``position``, the new one gets underscores behind its name. Documents without words or of a null
    text are never taken; ties are as in ``plan_mix`` and ``range_sort``; an empty table gives an empty result.
    """
    planned = plan_mix(docs, lambda row: word_count(row[text_col]), ["doc_id", text_col], curriculum)
    total = docs.agg(F.sum(word_count(F.col(text_col)))).first()[0] or 0
    copies = planned.withColumn("copy", F.explode("copies"))
    words, text = F.col("copy.words"), F.col("row")[text_col]
    cut = F.when(words < F.col("size"), first_words(text, words)).otherwise(text)
    name = free_name(docs, "position")
    copies = copies.select(F.col("row").withField(text_col, cut).alias("row"), F.col("copy.position").alias("at"))
    return range_sort(copies.select("row.*", F.col("at").alias(name)), F.col(name), total, curriculum)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    light = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    light = materialize(light, "mix-sizes")
    planned = plan_mix(light, lambda row: row["size"], ["doc_id", "size"])
    total = light.agg(F.sum("size")).first()[0] or 0
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda sum, copy: sum + copy["words"])
    rows = planned.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.size("copies").alias("copies"),
        F.get("copies", F.lit(0))["position"].alias("position"),
    )
    return range_sort(rows, F.col("position"), total)

"""Line deduplication with a suffix array over line ids (DataFrame functions only).

A document is a sequence of line ids. Prefix doubling ranks the suffixes that start at
repeated lines by their first 1, 2, 4, ... lines; suffixes whose rank is unique leave, and it ends when all are. The
last ranks are the suffix array; the ranks on the way give the longest common prefix of neighbours in it, by leaps of
powers of two. A suffix repeats as many lines as it shares with the nearer of its two neighbours; where that is not the
rest of a run that starts a line earlier, a maximal repeated run begins. Of the lines of these runs, those that
an earlier place already has are later copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm.common import WORD, boxed, free_name, in_order, lookup, materialize, read_table, row_hash

#: So many lines are a run; so is a single line of MIN_WORDS words.
MIN_LINES = 2
MIN_WORDS = 50

#: A line's place: ``doc`` numbers the different documents in the order of the corpus.
POSITION = ["doc", "line_no"]


def _position() -> Column:
    return F.struct(*POSITION)


def suffix_array(lines: DataFrame) -> DataFrame:
    """``lines(POSITION, line_id)`` => POSITION, ``place`` (from 1, in the order of the suffixes' lines) and ``history``.

    ``history`` holds a suffix's rank by its first 1, 2, 4, ... lines for as long as another has the same rank. A rank is the number of
    suffixes that are less, plus 1. A line that is not in ``lines``, or the end of a document, differs from all
    others and comes before them, in the order of the corpus.
    """
    size = F.count(F.lit(1)).alias("n")
    classes = in_order(lines.groupBy("line_id").agg(size), "line_id", sums=("n",))
    classes = materialize(classes.select("line_id", "n", (F.col("before_n") + 1).alias("rank")), "line-classes")
    current = lookup(lines.select(*POSITION, "line_id"), classes, "line_id", "n", lines.count()).drop("line_id")
    current = materialize(current.withColumn("history", F.array().cast("array<long>")), "suffixes")
    done, length = [], 1
    while True:
        done.append(current.where("n = 1").drop("n"))
        still = current.where("n > 1").withColumn("history", F.concat("history", F.array("rank"))).drop("n")
        n = still.count()
        if n == 0:
            break
        ranks = reduce(DataFrame.unionByName, [d.select(*POSITION, "rank") for d in [*done, still]])
        ranks = ranks.select("doc", (F.col("line_no") - length).alias("line_no"), F.col("rank").alias("rank2"))
        pairs = still.join(ranks, POSITION, "left").withColumn("rank2", F.coalesce("rank2", F.lit(0).cast("long")))
        own = F.when(F.col("rank2") == 0, _position()).otherwise(F.struct(F.lit(0).cast("long").alias("doc"), F.lit(0).alias("line_no")))
        pairs = materialize(pairs.withColumn("own", own), "suffix-pairs")
        key = ["rank", "rank2", "own"]
        ordered = in_order(pairs.groupBy(*key).agg(size).withColumnRenamed("rank", "rank1"), "rank1", *key[1:], sums=("n",)).drop("rank")
        ordered = materialize(ordered, "pair-classes")
        starts = ordered.groupBy("rank1").agg(F.min("before_n").alias("start"))
        ordered = ordered.join(starts, "rank1").select(
            F.struct(F.col("rank1").alias("rank"), *key[1:]).alias("key"), "n",
            (F.col("rank1") + F.col("before_n") - F.col("start")).alias("rank"),
        )
        keyed = pairs.select(F.struct(*key).alias("key"), *POSITION, "history")
        current = materialize(lookup(keyed, materialize(ordered, "pair-ranks"), "key", "n", n).drop("key"), "suffixes")
        length *= 2
    return materialize(reduce(DataFrame.unionByName, done).withColumnRenamed("rank", "place"), "suffix-array")


def common_prefixes(array: DataFrame) -> DataFrame:
    """``suffix_array`` => POSITION, ``place`` and ``lcp``, the longest common prefix with the suffix one place before, in lines."""

    def alike(a: str, b: str) -> Column:
        """The largest power of two of lines that two histories show as equal, or 0."""
        same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1))
        levels = F.coalesce(F.size(F.filter(same, lambda x: x.isNotNull())), F.lit(0))
        return F.when(levels > 0, F.pow(F.lit(2), levels - 1).cast("long")).otherwise(F.lit(0).cast("long"))

    before = array.select((F.col("place") + 1).alias("place"), _position().alias("other"), F.col("history").alias("theirs"))
    pairs = array.join(before, "place", "left").select(*POSITION, "other", "place", alike("history", "theirs").alias("leap"))
    moving, done = materialize(pairs.withColumn("lcp", F.col("leap")), "lcp"), []
    while True:
        done.append(moving.where("leap = 0").select(*POSITION, "place", "lcp"))
        moving = moving.where("leap > 0")
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, done)
        at = lambda name: array.select(
            F.col("doc").alias(f"{name}_doc"), F.col("line_no").cast("long").alias(f"{name}_line"), F.col("history").alias(name)
        )
        moving = moving.drop("leap").withColumns(
            {
                "ours_doc": F.col("doc"), "ours_line": F.col("line_no") + F.col("lcp"),
                "theirs_doc": F.col("other.doc"), "theirs_line": F.col("other.line_no") + F.col("lcp"),
            }
        )
        for name in ("ours", "theirs"):
            moving = moving.join(at(name), [f"{name}_doc", f"{name}_line"], "left")
        leap = alike("ours", "theirs")
        moving = moving.withColumn("leap", leap).withColumn("lcp", F.col("lcp") + F.col("leap"))
        moving = materialize(moving.select(*POSITION, "other", "place", "leap", "lcp"), "lcp")


def maximal_runs(prefixes: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``common_prefixes`` => POSITION and ``lines`` of each maximal run of ``min_lines`` or more lines that occurs more than once."""
    after = prefixes.select((F.col("place") - 1).alias("place"), F.col("lcp").alias("next_lcp"))
    repeats = prefixes.join(after, "place", "left").select(*POSITION, F.greatest("lcp", F.coalesce("next_lcp", F.lit(0))).alias("lines"))
    repeats = materialize(repeats.where(F.col("lines") >= min_lines), "repeats")
    above = repeats.select("doc", (F.col("line_no") + 1).alias("line_no"), F.col("lines").alias("above"))
    begins = F.coalesce(F.col("above") != F.col("lines") + 1, F.lit(True))
    return repeats.join(above, POSITION, "left").where(begins).drop("above")


def repeated_windows(array: DataFrame, min_lines: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes with a ``key`` of their first ``min_lines`` lines, and for each key that occurs again ``first``, its first place, and ``n``."""
    level = min_lines.bit_length() - 1
    ranked = array.select(*POSITION, F.get("history", F.lit(level)).alias("rank")).where("rank IS NOT NULL")
    rest = min_lines - (1 << level)
    if rest:  # the two ranked stretches overlap, so that they end at min_lines
        later = ranked.select("doc", (F.col("line_no") - rest).alias("line_no"), F.col("rank").alias("rank2"))
        keyed = ranked.join(later, POSITION).select(*POSITION, F.struct("rank", "rank2").alias("key"))
    else:
        keyed = ranked.select(*POSITION, F.col("rank").alias("key"))
    keyed = materialize(keyed, "windows")
    classes = keyed.groupBy("key").agg(F.min(_position()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed, materialize(classes, "window-classes")


def corpus_lines(docs: DataFrame) -> DataFrame:
    """POSITION, ``none``, ``id``, ``hash``, ``line_id`` and ``words`` of each line of the different documents."""
    doc_id = F.col("doc_id").cast("long")
    lines = docs.select(
        doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), row_hash("text").alias("hash"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    words = F.regexp_count("line", F.lit(WORD)).alias("words")
    return lines.select("none", "id", "hash", "line_no", F.unhex(F.md5("line")).alias("line_id"), words)


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``none``, ``id``, ``hash`` (of a document) and ``line_no`` (from 0) of each line that lies in a later copy of a run."""
    name = ["none", "id", "hash"]
    lines = materialize(corpus_lines(docs), "lines")
    again = lines.groupBy("line_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    active = lookup(lines, materialize(again, "repeated-lines"), "line_id", "n", lines.count()).drop("n")
    active = materialize(active.dropDuplicates([*name, "line_no"]), "active-lines")
    numbers = in_order(active.select(*name).distinct(), *name).withColumnRenamed("rank", "doc")
    numbers = materialize(numbers, "document-numbers")
    active = materialize(active.join(numbers, name).select(*POSITION, "line_id", "words"), "numbered-lines")
    array = suffix_array(active)
    runs = maximal_runs(common_prefixes(array), min_lines)
    # of a run's windows of min_lines lines, those that also begin at an earlier place cover its later copies
    start = F.explode(F.sequence("line_no", (F.col("line_no") + F.col("lines") - min_lines).cast("int")))
    windows = runs.select("doc", start.alias("line_no")).distinct()
    keyed, classes = repeated_windows(array, min_lines)
    keyed = materialize(keyed.join(windows, POSITION), "run-windows")
    later = lookup(keyed, classes, "key", "n", keyed.count()).where(_position() > F.col("first"))
    within = F.explode(F.sequence("line_no", F.col("line_no") + (min_lines - 1)))
    in_runs = later.select("doc", within.alias("line_no"))
    long_lines = active.where(F.col("words") >= min_words)
    firsts = materialize(long_lines.groupBy("line_id").agg(F.min(_position()).alias("first"), F.count(F.lit(1)).alias("n")), "long-lines")
    long_lines = lookup(long_lines, firsts, "line_id", "n", long_lines.count()).where(_position() > F.col("first")).select(*POSITION)
    return in_runs.unionByName(long_lines).distinct().join(numbers, "doc").select(*name, "line_no")


def drop_lines(text: Column, dropped: Column) -> Column:
    """A text without the lines whose numbers, sorted, are in ``dropped``."""

    def kept(lines: Column) -> Column:
        def stretch(i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1) + 1)
            end = F.coalesce(F.get(dropped, i), F.size(lines))
            return F.slice(lines, begin + 1, end - begin)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), stretch)), "\n")

    return F.when(F.size(dropped) == 0, text).otherwise(F.transform(F.array(F.split(text, "\n")), kept)[0])


def deduplicate_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, ``text`` without later copies of runs, then ``_dropped`` (their line numbers).

    A run is ``min_lines`` or more consecutive lines, or one line of ``min_words`` or more
    words, that also begins at an earlier place of the corpus (by doc_id, null last, then line; it
    may overlap itself). The first copy stays. Lines are compared exactly; an empty
    text is one empty line, a null text has none and stays null. Rows that repeat both id and
    text count as one document and get the same result. A document may end up empty.
    """
    name = ["none", "id", "hash"]
    dropped = later_copies(docs, min_lines, min_words)
    by_doc = dropped.groupBy(*name).agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))
    doc_id = F.col("doc_id").cast("long")
    keyed = boxed(docs, none=doc_id.isNull(), id=F.coalesce(doc_id, F.lit(0).cast("long")), hash=row_hash("text"))
    found = keyed.join(by_doc, name, "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.col("row").withField("text", drop_lines(F.col("row.text"), F.col("dropped")))
    return found.select(kept.alias("row"), "dropped").select("row.*", F.col("dropped").alias(free_name(docs, "_dropped")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("_dropped").cast("long").alias("n_dropped"), "text")


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents WHERE text IS NOT NULL
), paired AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM lines
), placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM paired
), marked AS (
  SELECT *, place > min(place) OVER (PARTITION BY line) AND
      len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS long_copy,
    next_line IS NOT NULL AND place > min(CASE WHEN next_line IS NOT NULL THEN place END)
      OVER (PARTITION BY line, next_line) AS run_copy
  FROM placed
), covered AS (
  SELECT *, long_copy OR run_copy OR coalesce(lag(run_copy) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS gone
  FROM marked
)
SELECT doc_id, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text
FROM covered GROUP BY doc_id
UNION ALL SELECT doc_id, 0, NULL FROM documents WHERE text IS NULL
"""

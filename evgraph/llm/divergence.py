"""How far the sources of a language differ in their words: a sort-based, streaming audit.

Tasks count the terms of stretches of documents. These counts are dealt by range of a number and sorted by it in each partition: a hash of
term and language, then one of the source. A scan over the runs gives document frequency and count of a term in a source. As the range ends
between the sources of a term, no term is too frequent for a task; runs that a border or equal hashes cut are added up afterwards. A second sort, by term within units of two blocks of sources and a
share of the terms, is scanned in the same way: each run of a term adds to the partial sums of all pairs of the two blocks, and the
unit emits them once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.common import materialize, read_table

#: Lower-cases A-Z and turns all that is in no term into blanks; bytes of other characters pass.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
#: A task's counts are sent on when they hold so many terms; a text is read in pieces of so many bytes.
HELD_TERMS, PIECE = 800_000, 1 << 22
#: Low bits of the number that counts are sorted by, those of the source; the others are of term and language.
SOURCE_BITS = 24
#: Sources of a block, on average, and rows of a unit. A run of a term in a unit has two blocks' sources at most.
SOURCE_BLOCK, UNIT_ROWS = 256, 1 << 17
#: Probabilities are in parts of this.
ONE = 1_000_000_000


@dataclass(frozen=True)
class Audit:
    """A term is kept in a language with at least ``min_docs`` of its documents; ``top`` terms of each source are reported."""

    min_docs: int = 10
    top: int = 10


def pieces_of(text: bytes) -> Iterator[bytes]:
    """``text`` with terms parted by blanks, in pieces that cut no term."""
    at = 0
    while at < len(text):
        to = at + PIECE
        piece = text[at:to].translate(TERM_BYTES)
        while to < len(text) and (more := text[to : to + 4096].translate(TERM_BYTES)) and piece[-1:] != b" ":
            end = more.find(b" ") + 1 or len(more)
            piece, to = piece + more[:end], to + end
        yield piece
        at = to


def _count_terms(most: int) -> Callable:
    """Batches of (lang, source, text) => counts of terms for each stretch of documents; ``most`` terms are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (docs, counts) in groups.items():
                size = len(docs)
                terms = pa.array(list(docs), pa.binary())
                same = [pa.repeat(pa.scalar(v), size) for v in (lang, source)]
                numbers = [pa.array(of, pa.int64()) for of in (list(docs.values()), [counts[t] for t in docs])]
                yield pa.RecordBatch.from_arrays([same[0], terms, same[1], *numbers], ["lang", "term", "source", "docs", "n"])
            groups.clear()

        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts):
                group = groups.get((lang, source))
                if group is None:
                    group = groups[lang, source] = (Counter(), Counter())
                docs, counts = group
                before, seen = len(docs), set()
                for piece in pieces_of(text.as_py()):
                    terms = piece.split()
                    counts.update(terms)
                    seen.update(terms)
                docs.update(seen)
                held += len(docs) - before
                if held >= most:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _scan_runs(min_docs: int) -> Callable:
    """Sorted (run, term, lang, source, docs, n) => one row for each run of the middle three, as they end.

    ``run`` is a number of term and language, and may be that of several. Those in fewer than ``min_docs`` documents together are left out, but for
    the first and the last number of a partition, which others may hold too.
    """
    key = ["term", "lang", "source"]

    def runs_of(table: pa.RecordBatch, columns: list[str]) -> np.ndarray:
        """Where runs of equal ``columns`` start."""
        differs = np.zeros(table.num_rows - 1, bool)
        for name in columns:
            column = table[name]
            differs |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
        return np.r_[0, np.flatnonzero(differs) + 1]

    def summed(table: pa.RecordBatch) -> pa.RecordBatch:
        starts = runs_of(table, key)
        sums = [pa.array(np.add.reduceat(table[c].to_numpy(), starts)) for c in ("docs", "n")]
        return pa.RecordBatch.from_arrays([*(table[c].take(pa.array(starts)) for c in ("run", *key)), *sums], ["run", *key, "docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at_border = None, True  # the runs of the last number so far

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = summed(batch)
            if held is not None:
                runs = summed(pa.concat_batches([held, runs]))
            terms = runs_of(runs, ["run"])
            held = runs.slice(terms[-1])
            if len(terms) > 1:
                ended = runs.slice(0, terms[-1])
                kept = np.add.reduceat(ended["docs"].to_numpy(), terms[:-1]) >= min_docs
                kept[0] |= at_border
                at_border = False
                yield ended.filter(pa.array(np.repeat(kept, np.diff(terms)))).drop_columns(["run"])
        if held is not None:
            yield held.drop_columns(["run"])

    return run


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(ONE * count / total), exact below 9 * 10^15: long division by thousands."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _unit_pairs(terms_at_once: int = 256) -> Callable:
    """Sorted rows of units => partial sums of the pairs of each unit.

    A unit's first rows, without a term, are the sources of its two blocks; the runs of its terms follow, kept terms of the language only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, heads, body = None, [], []

        def emit() -> Iterator[pa.RecordBatch]:
            lang, left_block, right_block = unit[:3]
            names = [h[0] for h in heads]
            left = [i for i, h in enumerate(heads) if h[1] == left_block]
            right = [i for i, h in enumerate(heads) if h[1] == right_block]
            totals = np.array([h[2] for h in heads], np.int64)
            sums, terms = np.zeros((len(left), len(right)), np.int64), 0
            place = {name: i for i, name in enumerate(names)}
            table = pa.Table.from_batches(body) if body else None
            if table is not None and len(table) and left and right:
                column = table["term"].combine_chunks()
                starts = np.r_[True, pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)]
                run_of, who = np.cumsum(starts) - 1, np.array([place[s] for s in table["source"].to_pylist()])
                count, terms = table["n"].to_numpy(), int(run_of[-1]) + 1
                most = max(1, min(terms_at_once, (1 << 22) // (len(left) * len(right))))
                for at in range(0, terms, most):
                    rows = slice(*np.searchsorted(run_of, [at, at + most]))
                    counts = np.zeros((min(most, terms - at), len(names)), np.int64)
                    counts[run_of[rows] - at, who[rows]] = count[rows]
                    p = share(counts + 2, totals)
                    sums += divergence(p[:, left, None], p[:, None, right]).sum(axis=0)
            # a term that no source of the unit has adds the same to a pair, wherever it is
            absent = share(np.full(len(heads), 2, np.int64), totals) if len(heads) and totals.min() > 0 else None
            none = divergence(absent[left][:, None], absent[None, right]) if absent is not None else np.zeros_like(sums)
            a, b = np.nonzero(np.array(left)[:, None] != np.array(right)[None, :]) if left and right else (np.array([], int),) * 2
            out = [
                pa.array([lang] * len(a), pa.string()), pa.array([names[left[i]] for i in a], pa.string()), pa.array([names[right[j]] for j in b], pa.string()),
                pa.array(sums[a, b] - terms * none[a, b]), pa.array(none[a, b]),
            ]
            yield pa.RecordBatch.from_arrays(out, ["lang", "source", "item", "value", "absent"])

        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in UNIT)))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if end == start:
                    continue
                if keys[start] != unit:
                    if unit is not None:
                        yield from emit()
                    unit, heads, body = keys[start], [], []
                part = batch.slice(start, end - start)
                is_head = part["term"].is_null().to_numpy(zero_copy_only=False)
                top = int(is_head.sum())  # null terms come first
                heads += zip(*(part[c].slice(0, top).to_pylist() for c in ("source", "block", "total")))
                body.append(part.select(["term", "source", "n"]).slice(top))
        if unit is not None:
            yield from emit()

    return run


UNIT = ["lang", "left_block", "right_block", "term_part"]


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``docs(lang, source, text)`` => lang, term, source, ``docs`` and ``n``: its documents and occurrences there.

    All terms in ``min_docs`` or more documents of a language are there, and few others.
    """
    schema = "lang string, term binary, source string, docs long, n long"
    counted = docs.select("lang", "source", "text").mapInArrow(_count_terms(HELD_TERMS), schema)
    counted = materialize(counted.withColumn("term", F.col("term").cast("string")), "term-counts")
    low = (1 << SOURCE_BITS) - 1
    run = F.xxhash64("lang", "term").bitwiseAND(F.lit(~low))
    number = run.bitwiseOR(F.xxhash64("source").bitwiseAND(F.lit(low)))  # one number, so that no texts are compared in sorting
    ranged = counted.repartitionByRange(number).sortWithinPartitions(number)
    runs = ranged.select(run.alias("run"), "term", "lang", "source", "docs", "n").mapInArrow(_scan_runs(min_docs), "term string, lang string, source string, docs long, n long")
    return runs.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def divergences(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """``docs(lang, source, text)`` => lang, source, part, item, value, rank: pairs of sources, and the terms that mark a source.

    Null texts, languages and sources read as empty; a row is a document, also one that repeats. A source is reported with all other sources
    of its language (none if it is alone), with value 0 where the language keeps no term. An empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(term_counts(docs, audit.min_docs), "term-runs")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= audit.min_docs)
    kept = materialize(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept-terms")
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"), F.count(F.lit(1)).alias("rows"))
    langs = langs.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"), F.sum("rows").alias("rows"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    zero = {"terms": 0, "lang_total": 0, "rows": 0, "total": 0}
    blocks = F.ceil(F.col("sources") / SOURCE_BLOCK).cast("int")
    groups = groups.fillna(zero).withColumns(
        {
            "total": F.col("total") + 2 * F.col("terms"), "lang_total": F.col("lang_total") + 2 * F.col("terms"),
            "blocks": blocks, "term_parts": F.greatest(F.ceil(2 * F.col("rows") / blocks / UNIT_ROWS), F.lit(1)).cast("int"),
            "block": F.pmod(F.xxhash64("source"), blocks).cast("int"),
        }
    )
    groups = materialize(groups, "groups")
    found = source_pairs(kept, groups).unionByName(marking_terms(kept, groups, audit.top))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= audit.top))


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """The summed divergence of each ordered pair of sources of a language."""

    def to_units(rows: DataFrame, part: Column) -> DataFrame:
        """Rows of a source in all units of its block with another, once in that of its block with itself."""
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        both = rows.select("*", others).withColumns({"left_block": F.least("block", "other"), "right_block": F.greatest("block", "other")})
        return both.select(*UNIT[:3], part.alias(UNIT[3]), "term", "source", "block", "total", "n")

    none = {"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}
    heads = to_units(groups.withColumns(none), F.explode(F.sequence(F.lit(0), F.col("term_parts") - 1)))
    placed = kept.join(groups.select("lang", "source", "block", "blocks", "term_parts"), ["lang", "source"]).withColumn("total", F.lit(0).cast("long"))
    body = to_units(placed, F.pmod(F.xxhash64("term"), F.col("term_parts")).cast("int"))
    dealt = heads.unionByName(body).repartition(*UNIT).sortWithinPartitions(*UNIT, F.col("term").asc_nulls_first(), "source")
    partial = dealt.mapInArrow(_unit_pairs(), "lang string, source string, item string, value long, absent long")
    partial = materialize(partial, "partial-pairs")
    # a pair of two blocks was taken once; the value is the same from either side
    blocks = groups.select("lang", "source", "block")
    in_one = partial.join(blocks, ["lang", "source"]).join(blocks.withColumnsRenamed({"source": "item", "block": "item_block"}), ["lang", "item"])
    across = in_one.where("block <> item_block").select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value", "absent")
    every = partial.unionByName(across)
    summed = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.first("absent").alias("absent"))
    summed = summed.join(groups.select("lang", "source", "terms"), ["lang", "source"])
    value = F.col("value") + F.col("absent") * F.col("terms")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))


def marking_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms of each source that its language has less often, with their divergence; the first ``top`` of each source."""

    def probability(n: str, total: str) -> Column:
        count = (F.col(n) + 2).cast("decimal(19,0)") * F.lit(ONE).cast("decimal(10,0)")
        return F.call_function("div", count, F.col(total).cast("decimal(19,0)")) + 1

    both = kept.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    both = both.select("lang", "source", F.col("term").alias("item"), probability("n", "total").alias("p"), probability("lang_n", "lang_total").alias("q"))
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    found = both.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM docs),
filled AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000 * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w)::BIGINT AS p,
    1 + (1000000000 * (lang_n + 2)) // (sum(lang_n) OVER w + 2 * count(*) OVER w)::BIGINT AS q
  FROM filled WINDOW w AS (PARTITION BY lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM found
QUALIFY part = 'pair' OR rank <= 10
"""

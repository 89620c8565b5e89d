"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text in windows of bytes, across words and whatever the script, and labels every
byte. A document's evidence is the sum of the log probabilities of all its bytes; its pooled probabilities
are the softmax of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.byte_gru import ByteGru
from evgraph.llm.common import boxed, materialize, read_table

UNDETERMINED = "und"
#: Bytes that the network reads at once; a text's last window is filled up with spaces, which do not count.
WINDOW = 64
#: Windows that are read together, and code points of text that are cut into windows at once (one text at least).
PASS_WINDOWS = 1024
PASS_CHARS = 1 << 20
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Training:
    """Bounds of the sample that the network is fitted on, and how.

    About ``docs_per_label`` documents of each label are drawn, and of their windows ``windows_per_label``, first one of each
    document, then a second one; with many labels fewer, so that there are ``windows`` in all at most. More labels than
    that are an error.
    """

    docs_per_label: int = 1000
    windows_per_label: int = 1500
    windows: int = 100_000
    units: int = 10
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


def held_out(id_col: Column) -> Column:
    """True for documents that nothing may be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text, lower-cased, in windows (row, byte), and how many bytes of each belong to the text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    rows = -(-len(data) // WINDOW)
    out = np.full(rows * WINDOW, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, WINDOW), np.minimum(WINDOW, len(data) - WINDOW * np.arange(rows))


def sample_windows(docs: DataFrame, training: Training = Training()) -> pd.DataFrame:
    """Columns ``lang``, ``window`` (binary) and ``length``: the sample that ``training`` bounds.

    Only labelled documents with an id that is not held out are read. Seeded hashes pick the documents of each label and
    the windows among all of theirs.
    """
    doc_id, seed = F.col("doc_id"), training.seed
    labelled = docs.where(F.col("lang").isNotNull() & doc_id.isNotNull() & F.col("text").isNotNull() & ~held_out(doc_id))
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.lit(seed), doc_id).alias("draw"))
    counts = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "label-counts")
    labels = counts.count()
    if labels > training.windows:
        raise ValueError(f"{labels} labels, but only {training.windows} windows to learn them from")
    share = F.least(F.lit(1.0), F.lit(float(training.docs_per_label)) / F.col("docs"))
    draw = F.pmod("draw", F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = labelled.join(counts, "lang").where(draw < share).select("lang", "text", "draw")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, text, number in frame.itertuples(index=False):
                windows, lengths = windows_of(text)
                nth = np.random.default_rng(abs(number)).permutation(len(windows))
                windows = [w.tobytes() for w in windows]
                yield pd.DataFrame({"lang": lang, "window": windows, "length": lengths, "draw": number, "nth": nth})

    found = picked.mapInPandas(cut, "lang string, window binary, length int, draw long, nth long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("nth", "draw", "window"))
    most = min(training.windows_per_label, training.windows // max(1, labels))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "window", "length").toPandas()


def fit(docs: DataFrame, training: Training = Training()) -> ByteGru | None:
    """A network for the labels of ``docs``; None if there is nothing to learn from."""
    found = sample_windows(docs, training)
    if found.empty:
        return None
    found = found.sort_values(["lang", "window", "length"])
    labels, index = np.unique(found["lang"], return_inverse=True)
    windows = np.frombuffer(b"".join(found["window"]), np.uint8).reshape(-1, WINDOW)
    lengths = found["length"].to_numpy(np.int64)
    weights = 1.0 / np.bincount(index, lengths)[index]
    rng = np.random.default_rng(training.seed)
    model = ByteGru.new([str(x) for x in labels], training.units, rng)
    model.train(windows, lengths, index, weights, training.epochs, training.batch, training.rate, rng)
    return model


def predict(model: ByteGru | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Label and pooled probability of each text; ``und`` and 0 for null or a text without a letter, and without a model."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    read = [i for i, text in enumerate(texts) if model is not None and text is not None and _LETTER.search(text)]
    if not read:
        return names, scores
    cut = [windows_of(texts[i]) for i in read]
    windows, lengths = (np.concatenate(side) for side in zip(*cut))
    owner = np.repeat(np.arange(len(read)), [len(w) for w, _ in cut])
    evidence = np.zeros((len(read), len(model.labels)))
    for at in range(0, len(windows), PASS_WINDOWS):
        part = slice(at, at + PASS_WINDOWS)
        np.add.at(evidence, owner[part], model.label_sums(windows[part], lengths[part]))
    pooled = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    best = pooled.argmax(axis=1)
    scores[read] = pooled.max(axis=1) / pooled.sum(axis=1)
    for i, label in zip(read, best):
        names[i] = model.labels[label]
    return names, scores


def _in_passes(texts: pd.Series) -> Iterator[list[str | None]]:
    """The texts in lists of about PASS_CHARS, so that what is held at once does not follow the batch."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held >= PASS_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def predict_languages(texts: Column, model: ByteGru | None) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a column of whole texts."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [predict(model, part) for part in _in_passes(batch)]
            yield pd.DataFrame(
                {
                    "lang_pred": [name for names, _ in parts for name in names],
                    "score": np.concatenate([scores for _, scores in parts]) if parts else np.zeros(0),
                }
            )

    return run(texts)


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``least_score``, with their columns as they were.

    Null texts and those without a letter go; repeated rows and null ids are rows like others. Where no label can be
    learned there is nothing to reject a document by, and all that have a letter stay. An empty table gives an empty result.
    """
    model = fit(docs)
    if model is None:
        return docs.where(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    found = boxed(docs, found=predict_languages(F.col("text"), model))
    kept = (F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least_score)
    return found.where(kept).select("row.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, repeated rows and null ids included; an empty table gives an empty result."""
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("doc_id", predict_languages(F.col("text"), fit(docs)).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")

"""Hard negatives, the divergence of sources and token files."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evgraph.llm import divergence, hard_negatives, token_files
from evgraph.llm.byte_bpe import ByteBpe, byte_bpe_encoder
from evgraph.llm.queries import QUERIES


# Hard negatives


def mined(rows, mining):
    """(id, label, vector, anchor) => sorted result tuples, from all pairs in Python integers."""
    whole = []
    for ident, label, vector, anchor in rows:
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            whole.append((ident, label, [int(np.floor(mining.scale * float(x))) for x in vector], anchor))
    by_id = lambda r: (r[0] is None, r[0] or 0)
    out = []
    for i, (ident, label, x, anchor) in enumerate(whole):
        if not anchor:
            continue
        scored = [(sum(a * b for a, b in zip(x, o[2])), o) for j, o in enumerate(whole) if j != i and len(o[2]) == len(x)]
        scored.sort(key=lambda s: (-s[0], by_id(s[1])))
        for score, positive in [s for s in scored if s[1][1] == label][: mining.positives]:
            fit = [s for s in scored if s[1][1] != label and mining.low * score <= 100 * s[0] <= mining.high * score]
            out += [(ident, positive[0], rank + 1, n[0], score, s) for rank, (s, n) in enumerate(fit[: mining.negatives])]
    return sorted(out, key=str)


SCHEMA = "id long, label int, vector array<float>, anchor boolean, score string, x int, row_no int"


def vectors(n, width, seed, labels=3):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), [float(np.float32(v)) for v in rng.normal(size=width) / 2], i % 7 == 0) for i in range(n)]


def odd_vectors():
    rows = vectors(150, 6, 1)
    rows += [(1000 + i, i % 3, rows[5][2], i % 5 == 0) for i in range(40)]  # copies, with ties by id
    rows += [rows[7]] * 9 + [(None, 1, rows[8][2], False), (None, 2, rows[8][2], False)]  # repeated rows, null ids
    rows += [(2000, None, rows[0][2], True), (2001, 1, None, True), (2002, 1, [0.5, None] * 3, True), (2003, 1, [float("nan")] + [0.0] * 5, True)]
    rows += [(2004, 1, [float("inf")] + [0.0] * 5, True), (2005, 1, [0.0] * 6, True), (2006, 2, [3e38] + [0.0] * 5, True)]
    rows += [(3000 + i, i % 2, [], i == 0) for i in range(4)] + [(4000 + i, i % 2, [1.0, 0.5 + i], True) for i in range(5)]
    rows += [(5000 + i, i % 2, [2e6, 1e6 + i / 256, 3.0], i < 2) for i in range(6)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("mining", [hard_negatives.Mining(), hard_negatives.Mining(positives=2, negatives=6, low=10, high=99)])
def test_hard_negatives_are_those_of_all_pairs(spark, mining, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 16)
    rows = odd_vectors()
    found = [tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows), mining).collect()]
    # one vector's score would be no long
    assert sorted(found, key=str) == mined([r for r in rows if r[0] != 2006], mining)
    assert len(found) > 100


def test_no_vectors_give_no_negatives(spark):
    assert hard_negatives.hard_negatives(frame(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, vectors(20, 4, 2, labels=1))).count() == 0


@pytest.mark.parametrize("learned", [True, False])
def test_bounds_hold_for_every_pair_whatever_the_codebook(learned):
    rng = np.random.default_rng(5)
    x = rng.integers(-3000, 3000, (400, 15))
    books = hard_negatives.learn_codebooks(x[:50] if learned else rng.normal(size=(50, 15)))
    code, bound = hard_negatives.encode(x, books)
    score = hard_negatives.looked_up(x[:60], code, books)
    spread = bound[:, None] * np.sqrt((x[:60].astype(float) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6
    assert (np.abs(score - x @ x[:60].T) <= spread).all()


def test_the_filter_leaves_few_rows_to_score():
    rng = np.random.default_rng(6)
    x = np.floor(256 * (u := rng.normal(size=(4000, 64))) / np.linalg.norm(u, axis=1, keepdims=True)).astype(int)
    code, bound = hard_negatives.encode(x, hard_negatives.learn_codebooks(x))
    score, exact = hard_negatives.looked_up(x[:50], code, hard_negatives.learn_codebooks(x)), x @ x[:50].T
    spread = bound[:, None] * np.linalg.norm(x[:50], axis=1)
    fifth = np.sort(score - spread, axis=0)[-6]
    assert ((score + spread >= fifth).sum(axis=0)).mean() < 20
    assert np.abs(score - exact).max() < 0.03 * 65536


# Divergence of sources


def audited(docs, audit):
    """(lang, source, text) => sorted result tuples by counting."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    is_term = lambda c: c.isascii() and c.isalpha() or ord(c) >= 0x80
    docs_of, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = "".join(c if is_term(c) else " " for c in text or "").translate(low).split(" ")
        terms = [t for t in terms if t]
        groups.add((lang, source))
        docs_of[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs_of[lang].items() if n >= audit.min_docs]

        def shares(of):
            total = sum(counts[of][t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[of][t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = shares((lang, source)), shares(lang)
        pairs = []
        for other in {s for g, s in groups if g == lang and s != source}:
            o = shares((lang, other))
            pairs.append((sum(f(p[t], o[t]) for t in kept), other))
        terms = [(f(p[t], q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, audit.top)):
            found.sort(key=lambda v: (-v[0], v[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:top])]
    return sorted(out)


def odd_documents():
    words = "Alpha beta GAMMA delta épsilon zêta eta_theta don't x1y2 中文 \U0001f600 ß ÀÉ".split()
    rng = np.random.default_rng(3)
    docs = []
    for i in range(240):
        text = " ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1))))
        docs.append((["en", "de", "", None, "fr"][i % 5], ["s1", "s2", "s3", None, "", "hot", "hot", "é"][i % 8], text))
    docs += [("en", "hot", "common common common")] * 60 + [("en", "empty", None), ("xx", "alone", "word " * 30), ("yy", "a", ""), ("yy", "b", None)]
    docs += [("en", "long", "alpha beta rare " * 20_000), ("en", "long", "x" * 100_000), ("de", "nul", "alpha\0beta\x7f")]
    return docs


def test_counts_are_sorted_by_one_number_that_several_terms_may_have(spark, monkeypatch, capsys):
    docs = odd_documents()
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    for bits in (24, 60, 63):
        monkeypatch.setattr(divergence, "SOURCE_BITS", bits)
        monkeypatch.setattr(divergence, "HELD_TERMS", 7)
        assert sorted(tuple(r) for r in divergence.divergences(df).collect()) == audited(docs, divergence.Audit())
    plain = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns])
    divergence.term_counts(plain, 10).explain()
    sorts = [line.split("Sort [", 1)[1].split("]")[0] for line in capsys.readouterr().out.splitlines() if "- Sort [" in line]
    assert len(sorts) == 1 and sorts[0].count("NULLS FIRST") == 1 and "xxhash64" in sorts[0]


@pytest.mark.parametrize("small", [False, True])
def test_divergences_are_those_of_plain_counts(spark, small, monkeypatch):
    if small:  # several blocks of sources, parts of terms, flushes and pieces
        for name, value in {"SOURCE_BLOCK": 2, "UNIT_ROWS": 16, "HELD_TERMS": 7, "PIECE": 50}.items():
            monkeypatch.setattr(divergence, name, value)
    docs = odd_documents()
    columns = "lang string, source string, text string, term string, n string, document int, value string, part int"
    df = spark.createDataFrame([(*d, "a", "b", 1, "c", 2) for d in docs], columns).repartition(5)
    for audit in (divergence.Audit(), divergence.Audit(min_docs=1, top=3)):
        found = divergence.divergences(df, audit)
        assert sorted(tuple(r) for r in found.collect()) == audited(docs, audit)
    assert divergence.divergences(df.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    counts, totals = [0, 1, 7, 10**6 + 3, 8 * 10**15 + 1], [1, 3, 7, 10**9 + 7, 9 * 10**15 - 1]
    found = divergence.share(np.array(counts), np.array(totals))
    assert found.tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals)]


def test_pieces_cut_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = ("short " + "l" * 9000 + " Été-x, " * 50).encode()
    whole = text.translate(divergence.TERM_BYTES).split()
    assert [t for piece in divergence.pieces_of(text) for t in piece.split()] == whole


# Token files


def test_token_files_come_back_whole_and_in_order(spark, docs, doc_rows, write_tables):
    found = [r.asDict() for r in QUERIES["op13_token_files"](spark, write_tables(documents=docs)).collect()]
    encode = byte_bpe_encoder()
    ids = {}
    for doc_id, text, *_ in doc_rows:
        tokens = np.append(encode(text or ""), 2).astype("<u4")
        ids.setdefault((doc_id is None, doc_id), []).append((len(tokens), zlib.crc32(tokens.tobytes())))
    assert len(found) == len(doc_rows)
    found.sort(key=lambda r: r["start"])
    assert [(r["doc_id"] is None, r["doc_id"] or 0) for r in found] == sorted((k[0], k[1] or 0) for k, v in ids.items() for _ in v)
    before = 0
    for r in found:
        assert r["start"] == before
        before += r["n_tokens"]
        ids[r["doc_id"] is None, r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))


def test_no_documents_give_readable_files(spark, no_docs, tmp_path):
    token_files.write_tokens(no_docs, f"{tmp_path}/none")
    assert token_files.TokenFiles(spark, f"{tmp_path}/none").documents().count() == 0


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('tokens')}/files"
    docs = spark.range(40_000).select((F.col("id") * 3).alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(i))) for i in "abcd"]).alias("text"))
    token_files.write_tokens(docs, path, stripe_bytes=1 << 18)
    return path


def test_files_hold_stripes_with_indexes_and_filters(many):
    from pyarrow import orc

    files = [orc.ORCFile(p) for p in sorted(Path(many).glob("*.orc"))]
    assert sum(f.nrows for f in files) == 40_000
    assert max(f.nstripes for f in files) > 3
    assert all(f.row_index_stride == token_files.GROUP_ROWS for f in files if f.nrows)
    # coded integers take less than the 4 bytes of a plain one
    assert sum(p.stat().st_size for p in Path(many).glob("*.orc")) < 4 * sum(f.read(["n_tokens"])["n_tokens"].to_numpy().sum() for f in files)


def test_stripes_are_read_in_parallel(spark, many):
    rows = token_files.TokenFiles(spark, many).documents
    files = len(list(Path(many).glob("*.orc")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 19)
        spark.conf.set("spark.sql.files.openCostInBytes", 1 << 12)
        tasks = token_files.TokenFiles(spark, many).rows.select(F.spark_partition_id().alias("task"), "doc_id")
        per_task = tasks.groupBy("task").count().collect()
        assert len(per_task) > files and sum(r["count"] for r in per_task) == 40_000
        assert rows().count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def scanned(df):
    """Rows that the scans of a plan give, as its metrics have them after a run."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            out.append(node.metrics().get("numOutputRows").get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return sum(out)


def test_searches_pass_by_what_cannot_hold_them(spark, many):
    files = token_files.TokenFiles(spark, many)
    there, absent = files.rows.where("doc_id = 60000"), files.rows.where("doc_id = 60001")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,60000)]" in there._jdf.queryExecution().toString()
    assert scanned(there) <= 2 * token_files.GROUP_ROWS  # of 40,000: row groups of other ranges are not read
    assert scanned(absent) == 0  # within the range of a row group, but not in its Bloom filter
    (row,) = files.find(60000).collect()
    (same,) = files.documents().where("doc_id = 60000").collect()
    assert row == same and row["n_tokens"] == len(row["ids"])


def test_a_window_of_ids_is_cut_out_of_its_documents(spark, many):
    files = token_files.TokenFiles(spark, many)
    first = files.documents().orderBy("start").limit(9).collect()
    stream = [x for r in first for x in r["ids"]]
    for start, length in ((0, 5), (first[2]["start"] - 3, 400), (first[1]["start"], first[1]["n_tokens"])):
        pieces = files.window(start, length).orderBy("start").collect()
        assert [x for p in pieces for x in p["ids"]] == stream[start : start + length]
        assert pieces[0]["start"] == start


# The batch encoder


def test_batches_are_encoded_as_the_library_does():
    import random

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    draw = random.Random(1)
    letters = "ab'stmdrevl  \t\n\r!?.,12é中ñß×Ⅳ²½\x00\x01'\"  "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(20_000)]
    texts += ["".join(chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x20000, 64)]  # all, in context
    texts += [f"a{chr(c)}b {chr(c)}1" for c in range(0x3000)]
    texts += [c * n for c in "a1.\n \xa0é中'" for n in (999, 1000, 5000)] + [" " * 3000 + "a", "", "<|endoftext|>", "a<|endoftext|>b", "😀 x"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    array = pa.array([None, *texts])
    for part in (array, array.slice(7, 900)):
        found = [x.tolist() for x in ByteBpe().batch(part)]
        assert found == ([[], *wanted] if part is array else wanted[6:906])


def test_every_text_of_the_table_is_encoded_as_the_library_does():
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = library.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(ByteBpe().batch(texts), wanted, strict=True))

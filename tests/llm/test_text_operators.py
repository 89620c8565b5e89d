"""Sharding, deduplication, mixing and packing against brute force on a small, awkward table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evgraph.llm import byte_bpe, components, exact_dedup, language_id, line_dedup, mixing, packing, sharding, simhash
from evgraph.llm.common import TASK_BYTES, deal, fresh_path, in_order, materialize, number_copies
from tests.llm.conftest import sentence

BIG = 1 << 62


def key(doc_id):
    return BIG if doc_id is None else doc_id


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Sharding


def test_shards_hold_every_row_once_in_gapless_slots(docs, doc_rows):
    out = sharding.shard(docs, 5, bucket_bytes=20_000).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == Counter((r[0], r[1], r[3]) for r in doc_rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["_shard_"]].append(r["_slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len({r["_shard_"] for r in out if r["doc_id"] == i}) for i in range(60)} == {1}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(5000).select(sharding.shard_of(F.col("id"), 8).alias("a"), sharding.shard_of(F.col("id"), 9).alias("b"))
    rows = ids.collect()
    assert all(r["b"] in (r["a"], 8) for r in rows)
    assert min(Counter(r["a"] for r in rows).values()) > 500 and 400 < sum(r["b"] == 8 for r in rows) < 720


def test_large_inputs_are_dealt_to_more_tasks(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert deal(rows, 40 * TASK_BYTES, "k").rdd.getNumPartitions() == 40 > few
    dealt = deal(rows, 10, "k").withColumn("part", F.spark_partition_id())
    assert dealt.rdd.getNumPartitions() <= few and dealt.select("k", "part").distinct().count() == 7


def test_shards_are_permuted_and_empty_tables_stay_empty(spark, no_docs, tmp_path):
    big = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shard(big, 1).orderBy("_slot").collect()
    ids = [r["doc_id"] for r in out]
    assert sorted(ids) == list(range(2000)) and sum(a < b for a, b in zip(ids, ids[1:])) < 1200
    assert sharding.shard(no_docs, 8).count() == 0
    sharding.write_shards(sharding.shard(big, 4), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2000


def test_op1(write_tables, docs, no_docs, spark, doc_rows):
    rows = sharding.op1_sharding(spark, write_tables(documents=docs)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in doc_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"key"} and all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert sharding.op1_sharding(spark, write_tables(documents=no_docs)).count() == 0


def test_copies_spread_and_slots_follow_from_the_records(spark, docs):
    same = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"), F.lit(9).alias("_shard"), F.lit("x").alias("n"))
    table = same.unionByName(spark.range(300).select("id", F.lit("t").alias("text"), F.lit(9).alias("_shard"), F.lit("y").alias("n")).withColumnRenamed("id", "doc_id"))
    numbered = number_copies(table)
    assert numbered.count() == 20_300 and numbered.select("draw").distinct().count() == 20_300
    assert numbered.groupBy(F.pmod("draw", F.lit(16))).count().agg(F.max("count")).first()[0] < 1600
    want = None
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for n in (3, 50):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sharding.shard(table, 3)
        assert got.columns == ["doc_id", "text", "_shard", "n", "_shard_", "_slot"]
        got = sorted(map(tuple, got.collect()))
        want = want or got
        assert got == want and {r[2] for r in got} == {9}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fisher_yates_is_what_it_says(spark):
    def brute(n, seed, draws):
        a = list(range(n))
        for place in range(n - 1, 0, -1):
            other = draws[place] % (place + 1)
            a[place], a[other] = a[other], a[place]
        return a

    for n in (0, 1, 2, 3, 40):
        rows = spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).alias("a") if n else F.array().cast("array<int>").alias("a"))
        got = rows.select(sharding.fisher_yates(F.col("a"), F.lit(4), seed=7)).first()[0]
        draws = spark.range(n + 1).select(F.xxhash64(F.lit(7), F.lit(4), F.col("id").cast("int"))).collect()
        assert got == brute(n, 7, [r[0] for r in draws])


# Exact deduplication


def test_a_repeated_batch_keeps_the_same_rows(spark, docs):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), 4)
    once, again = (exact_dedup.deduplicate(docs, index, batch="b1") for _ in range(2))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect())) and once.where("kept").count() == index.read().count()
    assert exact_dedup.drop_duplicates(docs, index, batch="b1").count() == index.read().count()
    assert exact_dedup.deduplicate(docs, index, batch="b2").where("kept").count() == 0


CLASH = "_key _hash _n _digest _cell _u _size _copy _found _none _group _bucket none id hash row draw nth digest position".split()


def test_columns_of_any_name_come_back_as_they_were(spark, doc_rows):
    rows = [(*r, *[f"{c}{i}" for c in CLASH]) for i, r in enumerate(doc_rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    docs = spark.createDataFrame(rows, schema).repartition(2)
    given = {(r[0], r[1], *r[5:]) for r in rows}
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), 4)
    results = [
        exact_dedup.drop_duplicates(docs, index), simhash.keep_one_of_each(docs), sharding.shard(docs, 2), mixing.mix(docs),
        line_dedup.deduplicate_lines(docs), language_id.keep_identified(docs),
    ]
    for out in results:
        assert out.columns[: len(docs.columns)] == docs.columns
        seen = {tuple(r[5 : len(docs.columns)]) for r in out.collect()}
        assert seen and seen <= {g[2:] for g in given}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark, docs, doc_rows):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), buckets=4)
    out = exact_dedup.deduplicate(docs, index).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in doc_rows:
        groups[normal(text)].append(doc_id)
    by_digest = {hashlib.sha256(t.encode()).digest(): g for t, g in groups.items()}
    assert len(out) == len(doc_rows)
    kept = Counter()
    for r in out:
        group = by_digest[bytes(r["digest"])]
        assert r["group_size"] == len(group) and key(r["keep_id"]) == min(map(key, group))
        kept[bytes(r["digest"])] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_index_outlives_the_batch(spark, docs, no_docs):
    path = fresh_path(spark, "index")
    first = exact_dedup.deduplicate(docs.where("doc_id >= 20"), exact_dedup.DigestIndex(spark, path, 4))
    n = first.where("kept").count()
    again = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, path, 4))
    assert exact_dedup.DigestIndex(spark, path, 4).read().count() == n + again.where("kept").count()
    known = {bytes(r["digest"]) for r in first.collect()}
    assert all(bytes(r["digest"]) not in known for r in again.where("kept").collect())
    assert exact_dedup.deduplicate(no_docs, exact_dedup.DigestIndex(spark, path, 4)).count() == 0
    explained = exact_dedup.DigestIndex(spark, path, 4).missing(spark.createDataFrame([(b"x",)], "digest binary"))
    plan = explained._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1


def test_index_is_sized_by_its_first_batch_and_keeps_its_buckets(spark, docs):
    path = fresh_path(spark, "index")
    first = exact_dedup.DigestIndex(spark, path)
    n = exact_dedup.deduplicate(docs, first).where("kept").count()
    assert first.buckets == exact_dedup.MIN_BUCKETS
    again = exact_dedup.DigestIndex(spark, path, 3)
    assert again.buckets == exact_dedup.MIN_BUCKETS and again.read().count() == n
    assert exact_dedup.deduplicate(docs, again).where("kept").count() == 0
    grown = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"))
    grown.prepare(100 * exact_dedup.BUCKET_DIGESTS)
    assert grown.buckets == 100 and grown.read().count() == 0


def test_dropping_copies_keeps_one_whole_row(spark, docs, doc_rows):
    out = exact_dedup.drop_duplicates(docs, exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), 4))
    assert out.columns == docs.columns
    assert sorted(normal(r["text"]) for r in out.collect()) == sorted({normal(r[1]) for r in doc_rows})


# SimHash


def brute_fingerprint(text):
    found = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(text)]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark, docs, doc_rows, write_tables):
    out = simhash.op2_simhash_near_dedup(spark, write_tables(documents=docs)).collect()
    fps = [(doc_id, brute_fingerprint(text)) for doc_id, text, *_ in doc_rows]
    distinct = sorted({f for _, f in fps})
    links = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2]
    root = brute_components(links, distinct)
    least = defaultdict(lambda: BIG)
    for doc_id, f in fps:
        least[root[f]] = min(least[root[f]], key(doc_id))
    want = Counter((doc_id, f"{f:016x}", None if least[root[f]] == BIG else least[root[f]]) for doc_id, f in fps)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == want


def test_fingerprints_alike_in_a_half_do_not_all_meet(spark):
    rng = np.random.default_rng(2)
    fps = spark.createDataFrame([(int(x) << 32 | 77,) for x in set(rng.integers(0, 1 << 31, 2000).tolist())], "fp long")
    near = fps.mapInArrow(simhash._to_anchors(2, False), "anchor long, rest long, fp long")
    assert near.groupBy("anchor", "rest").count().agg(F.max("count")).first()[0] < 100


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_no_link_is_lost(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    flips = [[int(b) ^ sum(1 << int(i) for i in rng.choice(63, k, replace=False)) for b in base[:80]] for k in range(1, 5)]
    values = sorted({int(b) for b in base} | {f for fs in flips for f in fs} | {-1, 0, 1, 3, -2})
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance).collect()
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & mask).bit_count() <= distance}
    assert {(r["u"], r["v"]) for r in found} == want and len(found) == len(want)


def test_links_are_never_broadcast(spark):
    """Many homes and anchors come out of a row, which Spark's sizes don't tell."""
    stored = materialize(spark.createDataFrame([(v,) for v in range(50)], "fp long"), "fps")
    plan = simhash.links(stored)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_of_each_near_group_stays(docs, no_docs, doc_rows):
    out = simhash.keep_one_of_each(docs)
    comps = {r["root"]: r["component_id"] for r in simhash.group_near_duplicates(docs).collect()}
    assert out.columns == docs.columns and sorted(map(str, comps.values())) == sorted(str(r["doc_id"]) for r in out.collect())
    assert simhash.group_near_duplicates(no_docs).count() == 0 and simhash.keep_one_of_each(no_docs).count() == 0


def test_groups_without_an_id_or_of_one_id_each_keep_a_row(spark):
    texts = [sentence(1000 + i, 40) for i in range(12)]
    rows = [(None, t) for t in texts[:8]] + [(5, t) for t in texts[8:]] + [(None, texts[0]), (5, texts[8]), (-(2**63), texts[1])]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(-(2**63), texts[1])] + [(None, t) for t in texts[:8] if t != texts[1]] + [(5, t) for t in texts[8:]]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(want)


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(400)] + [(5000, 5000)]
    edges += [tuple(map(int, rng.integers(2000, 2400, 2))) for _ in range(300)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert out == brute_components([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Lines


def brute_lines(rows, min_lines, min_words):
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0, xx(d[1])))
    places = [(d, i, line) for d in docs for i, line in enumerate(d[1].split("\n"))]
    seen, gone = {}, set()
    windows = []
    for at, (d, i, _) in enumerate(places):
        lines = d[1].split("\n")
        if i + min_lines <= len(lines):
            windows.append((at, ("run", *lines[i : i + min_lines]), [(d, i + k) for k in range(min_lines)]))
        if len(words(lines[i])) >= min_words:
            windows.append((at, ("long", lines[i]), [(d, i)]))
    for at, window, covered in windows:
        if seen.setdefault(window, at) < at:
            gone.update(covered)
    return {d: "\n".join(x for i, x in enumerate(d[1].split("\n")) if (d, i) not in gone) for d in docs}


def xx(text):
    """The order of texts with one id: that of Spark's hash of text and its being null."""
    from evgraph.llm.common import row_hash
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(text,)], "text string").select(row_hash("text")).first()[0]


@pytest.mark.parametrize("min_lines,min_words", [(2, 50), (3, 4), (1, 1000)])
def test_line_runs_match_brute_force(docs, doc_rows, min_lines, min_words):
    out = line_dedup.deduplicate_lines(docs, min_lines, min_words)
    want = brute_lines(doc_rows, min_lines, min_words)
    assert out.columns == [*docs.columns, "_dropped"]
    rows = out.collect()
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    assert got == Counter((r[0], None if r[1] is None else want[(r[0], r[1])]) for r in doc_rows)


def test_op5(spark, write_tables, docs, no_docs):
    assert line_dedup.op5_line_dedup(spark, write_tables(documents=docs)).count() == docs.count()
    assert line_dedup.op5_line_dedup(spark, write_tables(documents=no_docs)).count() == 0


def brute_suffixes(docs):
    """All suffixes, the common prefix of two, the longest that each shares with another, and the maximal runs."""
    places = [(d, i) for d, doc in enumerate(docs) for i in range(len(doc))]

    def common(p, q):
        a, b = docs[p[0]][p[1] :], docs[q[0]][q[1] :]
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    longest = {p: max([common(p, q) for q in places if q != p] or [0]) for p in places}
    runs = {(*p, n) for p, n in longest.items() if n >= 2 and longest.get((p[0], p[1] - 1)) != n + 1}
    return places, common, longest, runs


def test_suffix_array_and_runs_match_brute_force(spark):
    rng = np.random.default_rng(8)
    docs = [[int(x) for x in rng.integers(0, 12, rng.integers(1, 15))] for _ in range(12)]
    docs += [docs[0], docs[1] + docs[2], [1] * 9, [1] * 6, list(range(40)), [99, *range(40)], list(range(3, 40)), []]
    rows = [(d, i, line) for d, doc in enumerate(docs) for i, line in enumerate(doc)]
    table = line_dedup.suffix_array(spark.createDataFrame(rows, "doc long, line_no int, line_id long").repartition(3))
    array = sorted(table.collect(), key=lambda r: r["place"])
    places, common, longest, runs = brute_suffixes(docs)
    at = [(r["doc"], r["line_no"]) for r in array]
    assert max(len(r["history"]) for r in array) == 6  # 37 lines occur again: 1, 2, 4, ... 32, and none of 64
    assert sorted(at) == places and [r["place"] for r in array] == list(range(1, len(places) + 1))
    prefixes = {r["place"]: r["lcp"] for r in line_dedup.common_prefixes(table).collect()}
    assert prefixes == {1: 0} | {i: common(p, q) for i, (p, q) in enumerate(zip(at, at[1:]), 2)}
    assert all(max(prefixes[i], prefixes.get(i + 1, 0)) == longest[p] for i, p in enumerate(at, 1))
    found = line_dedup.maximal_runs(line_dedup.common_prefixes(table), 2).collect()
    assert {(r["doc"], r["line_no"], r["lines"]) for r in found} == runs and len(found) == len(runs)


def test_ranks_and_sums_follow_the_order_of_keys(spark):
    keys = spark.createDataFrame([(i * 37 % 500, "k", i) for i in range(500)], "a long, b string, n long").distinct()
    rows = in_order(keys, "a", sums=("n",)).orderBy("rank").collect()
    assert [(r["rank"], r["a"]) for r in rows] == [(i + 1, i) for i in range(500)]
    assert [r["before_n"] for r in rows] == [sum(r["n"] for r in rows[:i]) for i in range(500)]


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_targets_fill_up_to_their_bounds(spark):
    for sizes in ({"a": 1, "b": 100, "c": 900}, {"a": 5, None: 7}, {"x": 10}, {"a": 0, "b": 3, "z": 0}, {f"s{i:03}": i * i for i in range(50)}):
        rows = [(f"k{s}", s, n) for s, n in sizes.items()]
        got = {r["key"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "key string, source string, size long"))[0].collect()}
        want = brute_targets(sizes)
        assert got == {f"k{s}": pytest.approx(t) for s, t in want.items()}


def test_mix_takes_what_the_targets_ask(spark, docs, no_docs, doc_rows, write_tables):
    at = write_tables(documents=docs)
    out, again = (mixing.op7_mixing(spark, at).collect() for _ in range(2))
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes = Counter()
    for r in doc_rows:
        sizes[r[3]] += len(words(r[1]))
    targets, taken = brute_targets(sizes), Counter()
    source = dict((r[0], r[3]) for r in doc_rows if r[0] not in (None, 7, 8))
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] in source:
            assert r["target"] == pytest.approx(targets[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
        taken[round(r["target"], 6)] += r["taken"]
    want = Counter()
    for s, t in targets.items():
        want[round(t, 6)] += round(t)
    assert taken == want
    placed = [r["position"] for r in out if r["position"] is not None]
    assert all(0 <= p <= sum(sizes.values()) for p in placed)
    assert mixing.op7_mixing(spark, write_tables(documents=no_docs)).count() == 0


def test_copies_of_a_row_spread_over_cells_and_groups(spark):
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    plan = mixing.plan_mix(same, lambda row: mixing.word_count(row["text"]), ["doc_id", "text"], mixing.Curriculum(cell_rows=100))
    taken = [w["words"] for r in plan.collect() for w in r["copies"]]
    assert sum(taken) == 6000 and plan.count() == 3000
    pieces = packing.pack(same, group_bytes=1000)
    assert pieces.agg(F.sum("length"), F.count("*")).first() == (9000, 3000)
    groups = pieces.groupBy(F.shiftright("sequence_id", 32)).count().agg(F.count("*"), F.max("count")).first()
    assert groups[0] > 5 and groups[1] < 900


def test_stream_is_ranged_and_holds_the_words(docs, no_docs, doc_rows):
    curriculum = mixing.Curriculum(cell_rows=7, task_words=10_000)
    out = mixing.mix(docs, curriculum=curriculum)
    parts = out.select(F.spark_partition_id().alias("p"), "position", "text").collect()
    assert out.columns == [*docs.columns, "position"]
    assert [r["position"] for r in parts] == sorted(r["position"] for r in parts) and len({r["p"] for r in parts}) > 1
    total = sum(len(words(r[1])) for r in doc_rows)
    assert abs(sum(len(words(r["text"])) for r in parts) - total) <= 5
    assert mixing.mix(no_docs).count() == 0


# Packing


def test_first_fit_decreasing_is_what_it_says():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 700):
        lengths = rng.integers(1, 1024, n).tolist()
        bins, want = [], [None] * n
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, used in enumerate(bins) if used + lengths[i] <= 1024), None)
            if b is None:
                bins.append(0)
                b = len(bins) - 1
            want[i] = (b, bins[b])
            bins[b] += lengths[i]
        assert packing.first_fit_decreasing(lengths, 1024) == want


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(doc_rows):
    encode = byte_bpe.byte_bpe_encoder()
    odd = ["a  b", " a", "\t\tx\n\n  y ", "don't we'll I'M", "1234567 12.5%", "\x00\x01\x1c\x85z", "​ 　", "ﬁ é é", "<|endoftext|>", "𝔘𝔫𝔦"]
    for text in {r[1] for r in doc_rows if r[1] is not None} | set(odd):
        assert encode(text).tolist() == reference_ids(text), text[:40]


def test_pieces_cover_every_document(spark, docs, no_docs, doc_rows, write_tables):
    pieces = packing.pack(docs, group_bytes=100_000).collect()
    ends, got = Counter(), []
    for r in pieces:
        assert 1 <= r["length"] <= 1024 and len(r["ids"]) == 4 * r["length"]
    for seq in {r["sequence_id"] for r in pieces}:
        at = 0
        for r in sorted((r for r in pieces if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    want = Counter((r[0], tuple(reference_ids(r[1] or "")) + (0,)) for r in doc_rows)
    cover = defaultdict(lambda: defaultdict(list))
    for r in pieces:
        cover[(r["doc_id"], r["doc_tokens"])][r["start"]].append(np.frombuffer(r["ids"], "<u4"))
    for (doc_id, tokens), n in want.items():
        same = [t for (d, t), _ in want.items() if d == doc_id and len(t) == len(tokens)]
        if len(same) == 1:
            parts = cover[(doc_id, len(tokens))]
            assert all(len(p) == n for p in parts.values())
            got = np.concatenate([parts[s][0] for s in sorted(parts)])
            assert got.tolist() == list(tokens)
    assert sum(r["length"] for r in pieces) == sum(len(t) * n for (_, t), n in want.items())
    rows = packing.op6_packing(spark, write_tables(documents=docs)).collect()
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    padding = sum(0 if u & (u - 1) == 0 else 1024 - u for u in used.values())
    assert padding <= 0.02 * sum(used.values())
    assert packing.op6_packing(spark, write_tables(documents=no_docs)).count() == 0

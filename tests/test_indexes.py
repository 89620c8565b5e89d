"""The indexes of text and of arcs against plain searches over all rows."""

import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from evgraph.operators import adjacency_index, text_index
from evgraph.operators import graph as G
from evgraph.plans import stored
from evgraph.schema import EDGE

NODE = "id string, kind string, name string, qualified_name string, route string, file string"
TEXTS = ["order", " ORDER\t", "o", "de", "é", "ßx", "😀b", "a😀", "nothing here", "", "   ", None, "src/a.cs", "get /orders", "x" * 300, "aaa", "aaaa", ".", "orderservice", "s/0"]


def fold(text):
    return (text or "").strip().lower()


def ladder(row, q):
    name, qn, route, file = ((x or "").lower() for x in row[2:])
    for hit, points in (
        (name == q, 1000), (qn == q, 950), (route == q, 900), (name.startswith(q), 800), (q in name, 700),
        (qn.startswith(q), 600), (q in qn, 500), (q in route, 400), (q in file, 300),
    ):
        if hit:
            return points
    return 0


@pytest.fixture(scope="module")
def nodes():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        word = rng.choice(["Order", "OrderService", "order", "deed", "Aaaa", "a😀b", "ßxé", "", None, "zz" * rng.randrange(5), "x" * 2000])
        route = rng.choice([None, "", f"/orders/{i % 7}", "GET /orders"])
        rows.append((f"n{i:03}", rng.choice(["class", "method"]), word, f"{word}.{i % 50}", route, rng.choice([None, "", "src/A.cs", "src/orders.ts", f"s/{i % 3}"])))
    return [*rows, rows[5], (None, None, "Order", None, None, None)]


def test_searches_equal_a_scan(spark, nodes, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 64)
    index = text_index.TextIndex.build(spark.createDataFrame(nodes, NODE), str(tmp_path / "index"), buckets=8)
    asked = [(f"{i}", text, kind) for i, text in enumerate(TEXTS) for kind in (None,)] + [("k", "order", "class"), ("none", "order", "page")]
    want = {}
    for query, text, kind in asked:
        hits = [(-ladder(row, fold(text)), row[0] or "") for row in nodes if fold(text) and kind in (None, row[1])]
        want[query] = sorted(hit for hit in hits if hit[0])
    queries = spark.createDataFrame(asked, "query string, text string, kind string")
    # the second is another session's way in
    for found, limit in ((index, 3), (text_index.TextIndex.open(spark, str(tmp_path / "index")), 1000)):
        got = {}
        for r in sorted(found.search(queries, limit).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query"], []).append(r)
        for query, text, _ in asked:
            rows = got.get(query, [])
            assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
            assert [(-r["score"], r["id"] or "") for r in rows] == want[query][:limit], text


@pytest.fixture
def buckets_shown(spark):
    """Plans say how many buckets a scan opens only where they don't split its files otherwise."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    yield
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_are_cut_delta_coded_and_pruned(spark, buckets_shown, nodes, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 64)
    index = text_index.TextIndex.build(spark.createDataFrame(nodes, NODE), str(tmp_path / "index"), buckets=16)
    lists = index.tables["postings"].collect()
    assert max(len(r["offsets"]) for r in lists) <= 64 and all(r["offsets"] == sorted(set(r["offsets"])) for r in lists)
    file = next((tmp_path / "index" / "postings").glob("*.parquet"))
    meta = pq.ParquetFile(file).metadata.row_group(0)
    offsets = next(meta.column(i) for i in range(meta.num_columns) if "offsets" in meta.column(i).path_in_schema)
    assert "DELTA_BINARY_PACKED" in offsets.encodings
    wanted = spark.createDataFrame([("q", "ord")], "query string, gram string")
    assert "SelectedBucketsCount: 1 out of 16" in plan_of(stored.lookup_rows(index.tables["postings"], wanted, "gram"))
    # many grams go to the buckets, which are not shuffled
    monkeypatch.setattr(stored, "LITERALS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan_of(stored.lookup_rows(index.tables["postings"], wanted, "gram")).count("Exchange hashpartitioning") == 1
        queries = spark.createDataFrame([("q", "order")], "query string, text string")
        assert index.search(queries, 5).count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_index(spark, tmp_path):
    index = text_index.TextIndex.build(spark.createDataFrame([], NODE), str(tmp_path / "index"))
    queries = spark.createDataFrame([("q", "order"), ("r", "o")], "query string, text string")
    assert index.search(queries).collect() == []
    assert index.search(queries.limit(0)).collect() == []


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(40)]
    node = "id string, kind string, file string, evidence array<struct<file:string,line_start:long,line_end:long,rev:string>>, first_seen_rev string, last_seen_rev string"
    rows = [(x, "class", "a.cs", [("a.cs", 1, 1, "r")], "r", "r") for x in ids] + [("file:a.cs", "file", "a.cs", [("a.cs", 1, 1, "r")], "r", "r")]
    links = [("hub", rng.choice(ids)) for _ in range(300)] + [tuple(rng.choices(ids, k=2)) for _ in range(60)] + [("n1", "n1"), ("n2", "gone"), (None, "n3")]
    edges = [{"id": f"e{i}", "src": s, "dst": d, "kind": "calls"} for i, (s, d) in enumerate(links)]
    nodes = spark.createDataFrame([*rows, ("hub", "class", "a.cs", [], "r", "r")], node)
    return nodes, spark.createDataFrame([tuple(e.get(f) for f in EDGE.fieldNames()) for e in edges], EDGE)


def test_arcs_equal_those_of_the_edges(spark, graph, tmp_path):
    nodes, edges = graph
    path = str(tmp_path / "arcs")
    adjacency_index.AdjacencyIndex.build(nodes, edges, path, block=16)
    index = adjacency_index.AdjacencyIndex.open(spark, path)
    want = [tuple(r) for r in G.adjacency(nodes, edges).where("from_id IS NOT NULL AND to_id IS NOT NULL").collect()]
    assert Counter(map(tuple, index.arcs().collect())) == Counter(want)
    assert index.blocks.selectExpr("max(size(arcs))").head()[0] <= 16 and index.offsets.where("from_id = 'hub'").count() > 15
    assert {r["id"]: r["n"] for r in index.degrees().collect()} == Counter(a[0] for a in want)
    by_node = {}
    for a in sorted(want, key=lambda a: (a[0], a[2])):
        by_node.setdefault(a[0], []).append(a)
    got = {(r["from_id"], r["place"]): r["to_id"] for r in index.places().collect()}
    assert got == {(x, i): a[1] for x, arcs in by_node.items() for i, a in enumerate(arcs)}
    for start, size in ((0, 5), (30, 40), (290, 100), (1000, 5)):
        page = sorted((r["place"], r["to_id"]) for r in index.page("hub", start, size).collect())
        assert page == [(i, a[1]) for i, a in enumerate(by_node["hub"])][start : start + size]
    assert index.page("unknown", 0, 10).collect() == []


def test_explain_and_neighbours_by_index(spark, buckets_shown, graph, tmp_path):
    nodes, edges = graph
    index = adjacency_index.AdjacencyIndex.build(nodes, edges, str(tmp_path / "arcs"), buckets=16, block=16)
    for x in ("n1", "n2", "hub", "gone", "n39"):
        want = G.explain_node(nodes, edges, x).where("src IS NOT NULL").select("direction", "id", "src", "dst").collect()
        got = index.explain(spark.createDataFrame([(x,)], "id string"))
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want)), x
        assert "SelectedBucketsCount: 1 out of 16" in plan_of(got)
    focus = spark.createDataFrame([("n1",), ("hub",), ("gone",), ("n2",), ("n2",), (None,)], "id string")
    for mode in ("expand", "upstream", "downstream"):
        assert set(map(tuple, index.neighbors(focus, mode).collect())) == set(map(tuple, G.neighbors(nodes, edges, focus, mode).collect()))

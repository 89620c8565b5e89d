"""What stays on disk and what is broadcast."""

import glob
import time

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evgraph.functions import hash_tree, text_parts
from evgraph.operators import adjacency_index, paths
from evgraph.operators.delta import DeltaTable
from evgraph.plans import render
from evgraph.plans.shared import materialize
from evgraph.plans.stored import write_bucketed
from evgraph.sources import tabular


def _shuffles(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirsString() for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def _settles(spark, before):
    """Whether the shuffle files are those of before, soon: they are removed in the background."""
    for _ in range(50):
        if not _shuffles(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_shuffle_files_go_with_the_table_that_they_made(spark, tmp_path):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = _shuffles(spark), spark.conf.get(setting)
    rows = spark.range(20_000).groupBy((F.col("id") % 5_003).alias("k")).count()
    materialize(rows, "counts")
    write_bucketed(rows, str(tmp_path / "b"), "k", [], 4)
    assert _settles(spark, before) and spark.conf.get(setting) == own


def test_distances_need_no_ids_of_edges(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("a", "c"), ("c", "d")], "from_id string, to_id string")
    assert {(r["id"], r["distance"]) for r in paths.distances(arcs, "a").collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert paths.distances(arcs, "a", 1).count() == 3 and paths.distances(arcs, "none").collect() == [("none", 0)]


def test_large_tables_of_the_graph_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tabular, "BROADCAST_BYTES", 0)
    plan = tabular.edges(spark, "/root/testdata/sf0.001").where("kind = 'references'")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_arcs_of_an_index_move_twice_at_most(spark, tmp_path, monkeypatch):
    """Once to be numbered and once to their buckets; marks of unknown ends leave them where they are."""
    plans, write = [], adjacency_index.write_bucketed

    def watched(rows, path, *args, **more):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, path, *args, **more)

    monkeypatch.setattr(adjacency_index, "write_bucketed", watched)
    graph = tabular.graph(spark, "/root/testdata/sf0.001")
    edges = graph.edges.where("kind = 'contains'")
    edges = edges.unionByName(edges.limit(3).withColumn("dst", F.lit("class:none")))
    index = adjacency_index.AdjacencyIndex.build(graph.nodes, edges, str(tmp_path / "arcs"), buckets=4)
    assert plans[0].count("Exchange hashpartitioning") == 1
    marks = index._unpacked(index.blocks).where("to_id = 'class:none' OR from_id = 'class:none'")
    assert {(r["from_id"] != "class:none", r["from_known"], r["to_known"]) for r in marks.collect()} == {(True, True, False), (False, False, True)}


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_details_join_edges_once_an_end(spark):
    graph = tabular.graph(spark, "/root/testdata/sf0.001")
    edges = materialize(graph.edges, "edges")
    nodes = materialize(graph.nodes, "nodes")
    assert _plan(render.detail_lines(nodes, edges)).count("Join ") == 2


def test_texts_stay_in_their_buckets(spark):
    graph = tabular.graph(spark, "/root/testdata/sf0.001")
    nodes = graph.nodes.where("kind = 'class'")
    parts = text_parts.document_parts(nodes, graph.edges.where("kind = 'contains'"))
    small = spark.range(3).withColumnRenamed("id", "part").hint("merge")
    assert parts.join(small, "part")._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    hashes = text_parts.part_hashes(nodes, graph.edges.where("kind = 'contains'"))
    assert sorted(hashes.collect()) == sorted(parts.select("part", "bytes", "sha256").collect()) and hashes.columns == ["part", "bytes", "sha256"]


def test_changes_of_a_table_leave_no_shuffle_files(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("first_seen_rev", StringType()), StructField("last_seen_rev", StringType())])
    before, stored = _shuffles(spark), DeltaTable(spark, str(tmp_path / "t"), schema, 4)
    stored.upsert(spark.createDataFrame([(str(i), "a", "a", i) for i in range(50)], "id string, first_seen_rev string, last_seen_rev string, ordinal int"))
    stored.compact()
    assert _settles(spark, before)


def test_rows_of_a_hash_tree_are_a_table(spark):
    graph = tabular.graph(spark, "/root/testdata/sf0.001")
    nodes, edges = graph.nodes.where("kind = 'class'"), graph.edges.where("kind = 'contains'")
    rows = hash_tree.leaf_rows(nodes, edges, "first_seen_rev")
    assert "Join" not in _plan(rows) and "first_seen_rev" in rows.columns
    assert sorted(hash_tree.build(rows, 1).collect()) == sorted(hash_tree.build(hash_tree.placed(nodes, edges), 1).collect())

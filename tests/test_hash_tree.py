"""Hash trees: a refreshed tree is the built one, and differences are found from the root down."""

import pytest
from pyspark.sql import functions as F

from evgraph.functions import hash_tree


def records(spark, n, salt=""):
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "node").otherwise("edge").alias("part"), F.concat(F.lit("r"), F.col("id")).alias("id"))
    return rows.withColumn("sha256", F.sha2(F.concat("id", F.lit(salt)), 256)).withColumn("place", F.sha2(F.concat_ws(":", "part", "id"), 256))


def nodes(tree):
    return {(r["level"], r["prefix"]): (r["rows"], r["hash"]) for r in tree.collect()}


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_a_change_redoes_its_leaves_only_and_gives_the_built_tree(spark, depth):
    old = records(spark, 600)
    tree = hash_tree.build(old, depth)
    touched = [("node", "r3"), ("edge", "r4"), ("edge", "new")]
    ids = spark.createDataFrame(touched, "part string, id string")
    gone_and_same = old.join(ids, ["part", "id"], "left_anti").select(*old.columns)
    fresh = ids.where("id <> 'r4'").withColumn("sha256", F.sha2("id", 224)).withColumn("place", F.sha2(F.concat_ws(":", "part", "id"), 256))
    now = gone_and_same.unionByName(fresh.select(*old.columns))
    refreshed, built = nodes(hash_tree.refresh(tree, now, ids, depth)), nodes(hash_tree.build(now, depth))
    assert refreshed == built != nodes(tree)
    assert built[0, ""][0] == 600
    leaves = hash_tree.differing_leaves(tree, hash_tree.build(now, depth), depth)
    assert 1 <= leaves.count() <= 3
    found = hash_tree.differing_records(old, now, leaves, depth).collect()
    assert sorted(map(tuple, found)) == sorted(touched)


def test_equal_and_empty_graphs(spark):
    tree, none = hash_tree.build(records(spark, 50), 1), hash_tree.build(records(spark, 0), 1)
    assert hash_tree.differing_leaves(tree, hash_tree.build(records(spark, 50).repartition(7), 1), 1).count() == 0
    assert none.count() == 0
    found = hash_tree.differing_leaves(tree, none, 1).collect()
    assert sum(r["rows_a"] for r in found) == 50 and {r["rows_b"] for r in found} == {0}


def test_leaves_stay_small():
    assert [hash_tree.depth_of(n) for n in (0, 1024, 1025, 16384, 16385, 10**11)] == [0, 0, 1, 1, 2, 7]

"""Trees of files without excluded folders, and streams with keyed state."""

import builtins
import os

import pytest
from pyspark.sql import functions as F

from evgraph.sources import scan, tree
from evgraph.streaming.state import KeyedStream

PATHS = {
    "top.txt": "t", "src/a.cs": "a", "src/deep/er/b.ts": "é" * 10, "src/.DS_Store": "no", "src/empty.txt": "",
    "node_modules/x/index.js": "no" * 999, "src/node_modules/y.js": "no", "src/obj/c.cs": "no", "lib/bin/d.cs": "no", "lib/keep/e.cs": "e",
    "lib/binary/f.cs": "f", "vendor/g.cs": "g",
}
SEEN = {p: c for p, c in PATHS.items() if not {*p.split("/")} & {*scan.EXCLUDED, ".DS_Store"}}


@pytest.fixture
def root(tmp_path):
    for path, text in PATHS.items():
        at = tmp_path / "tree" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, encoding="utf-8")
    os.symlink(tmp_path / "tree" / "src", tmp_path / "tree" / "linked")
    os.symlink(tmp_path / "tree" / "top.txt", tmp_path / "tree" / "src" / "linked.txt")
    return str(tmp_path / "tree")


def found(files):
    return {r["path"]: bytes(r["content"]).decode() for r in files.collect()}


def test_listing_leaves_out_folders_files_and_links(spark, root):
    assert found(scan.list_files(spark, root)) == SEEN
    assert found(scan.list_files(spark, f"file://{root}", exclude=("vendor",))) == {p: c for p, c in SEEN.items() if p != "vendor/g.cs"}
    assert sorted(found(scan.list_files(spark, root, include=("src/deep", "top.txt")))) == ["src/deep/er/b.ts", "top.txt"]
    assert sorted(found(scan.list_files(spark, root, keep=F.col("path").startswith("lib/")))) == ["lib/binary/f.cs", "lib/keep/e.cs"]
    # through Spark's own reader, which follows links
    stored = found(scan.stored_files(spark, f"file://{root}", scan.EXCLUDED))
    assert {p: c for p, c in stored.items() if "linked" not in p} == SEEN
    assert all(r["content"] is None for r in tree.read_tree(spark, root, content=False).collect())
    os.makedirs(f"{root}-none/.git/x")
    assert scan.list_files(spark, f"{root}-none").count() == scan.stored_files(spark, f"file://{root}-none", scan.EXCLUDED).count() == 0


@pytest.mark.parametrize("folders", [1, 3, 256])
def test_what_is_excluded_is_neither_listed_nor_read(root, monkeypatch, folders):
    monkeypatch.setattr(tree, "FOLDERS", folders)
    listed, opened, scandir, plain = [], [], os.scandir, builtins.open
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(os.path.relpath(p, root)) or scandir(p))
    monkeypatch.setattr(builtins, "open", lambda p, *a, **k: opened.append(os.path.relpath(p, root)) or plain(p, *a, **k))
    options = {"root": root, "exclude": '["node_modules", "obj", "bin"]', "ignore": '[".DS_Store"]'}

    def rows(reader):
        return {p: c.decode() for part in reader.partitions() for b in reader.read(part) for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist())}

    assert rows(tree.TreeReader(options)) == SEEN
    assert sorted(opened) == sorted(SEEN)
    assert not [p for p in listed if {*p.split("/")} & {"node_modules", "obj", "bin", "linked"}]
    listed.clear(), opened.clear()
    reader = tree.TreeReader(options | {"include": '["src/deep/"]'})
    assert list(rows(reader)) == ["src/deep/er/b.ts"] == opened
    assert set(listed) <= {".", "src", "src/deep", "src/deep/er"}


def test_a_tree_is_written_whole_or_not_at_all(spark, tmp_path):
    root = f"{tmp_path}/out"
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.txt", f"text {i}") for i in range(40)], "path string, content string").repartition(4)
    tree.write_tree(rows, root)
    assert found(tree.read_tree(spark, root)) == {f"d{i % 3}/f{i}.txt": f"text {i}" for i in range(40)}
    broken = rows.unionByName(spark.createDataFrame([("../out-of-it", "x")], "path string, content string"))
    with pytest.raises(Exception, match="not below the root"):
        tree.write_tree(broken, root, overwrite=True)
    assert len(found(tree.read_tree(spark, root))) == 40 and sorted(os.listdir(tmp_path)) == ["out"]
    with pytest.raises(Exception, match="FileExistsError"):
        tree.write_tree(rows.limit(1), root)
    tree.write_tree(rows.limit(0), root, overwrite=True)
    assert found(tree.read_tree(spark, root)) == {} and sorted(os.listdir(tmp_path)) == ["out"]


# Streams


def feed(spark, log, rows):
    spark.createDataFrame(rows, "k string, n long, v string, w string, gone boolean").coalesce(1).write.mode("append").parquet(log)


def stream_at(spark, tmp_path, **more):
    schema = "k string, n long, v string, w string, gone boolean"
    return KeyedStream(spark, f"file://{tmp_path}/home", schema, "k", "n", first=("w",), deleted=F.col("gone"), **more)


def table_of(stream):
    return sorted(tuple(r)[:4] for r in stream.table().select("k", "n", "v", "w").collect())


@pytest.mark.parametrize("compact", [False, True])
def test_a_stream_writes_what_changed_and_goes_on(spark, tmp_path, compact):
    log, stream = f"file://{tmp_path}/log", stream_at(spark, tmp_path)
    assert table_of(stream) == []
    feed(spark, log, [(f"k{i}", i, "old", f"w{i}", False) for i in range(300)])
    stream.advance(log)
    if compact:
        stream.compact()
    # one key anew, one changed, one deleted, one late change that counts no more
    feed(spark, log, [("new", 1000, "x", "first", False), ("k7", 1001, "changed", "later", False), ("k8", 1002, None, None, True), ("k9", -1, "late", "early", False)])
    stream = stream_at(spark, tmp_path)  # another session's
    stream.advance(log)
    assert stream.changes().groupBy("batch").count().orderBy("batch").collect()[-1]["count"] == 4
    wanted = {f"k{i}": (i, "old", f"w{i}") for i in range(300)} | {"new": (1000, "x", "first"), "k7": (1001, "changed", "w7"), "k9": (9, "old", "early")}
    del wanted["k8"]
    assert table_of(stream) == sorted((k, *v) for k, v in wanted.items())
    stream.advance(log)
    assert table_of(stream) == sorted((k, *v) for k, v in wanted.items())
    if compact:
        stream.compact()
        assert stream.changes() is None
    feed(spark, log, [("k8", 2000, "back", "again", False)])
    stream.advance(log)
    assert ("k8", 2000, "back", "w8") in table_of(stream)


def test_nulls_of_a_merge_leave_what_was_there(spark, tmp_path):
    log, stream = f"file://{tmp_path}/log", stream_at(spark, tmp_path, merge=True)
    feed(spark, log, [("a", 1, "one", "w", False), ("b", 2, None, None, False)])
    feed(spark, log, [("a", 3, None, None, False), ("b", 4, "two", "late", None)])
    stream.advance(log)
    assert table_of(stream) == [("a", 3, "one", "w"), ("b", 4, "two", None)]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    log, stream = f"file://{tmp_path}/log", stream_at(spark, tmp_path)
    feed(spark, log, [("a", 1, "x", "w", False)])
    stream.advance(log)
    last = max(int(p.name) for p in (tmp_path / "home" / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "home" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    stream_at(spark, tmp_path).advance(log)
    assert table_of(stream) == [("a", 1, "x", "w")]

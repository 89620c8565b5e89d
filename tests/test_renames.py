"""Renames of edited files against plain comparison of all pairs."""

import random
from collections import Counter, defaultdict

import pytest

from evgraph.operators import incremental, renames

SCHEMA = "path string, content_sha string, content string"


def rows(spark, files):
    return spark.createDataFrame([(p, None if c is None else f"sha-{hash(c)}", c) for p, c in files.items()], SCHEMA).repartition(3)


def similarity(a, b):
    """(shared bytes, per cent of the larger file)."""
    x, y = (Counter(c.split("\n")) for c in (a, b))
    shared = sum(n * (len(line.encode()) + 1) for line, n in (x & y).items())
    larger = max(len(c.encode()) + 1 for c in (a, b))
    return shared, 100 * shared // larger, 100 * shared, larger


def greedy(gone, came, least):
    """Pairs of paths: contents by similarity, shared bytes and first paths, files of a content by path."""
    of = [defaultdict(list), defaultdict(list)]
    for side, files in zip(of, (gone, came)):
        for path in sorted(files):
            if files[path]:
                side[files[path]].append(path)
    scored = []
    for a, old in of[0].items():
        for b, new in of[1].items():
            shared, percent, part, larger = similarity(a, b)
            if a != b and part >= least * larger:
                scored.append((-percent, -shared, old[0], new[0], a, b))
    out = set()
    for _, _, _, _, a, b in sorted(scored):
        while of[0][a] and of[1][b]:
            out.add((of[0][a].pop(0), of[1][b].pop(0)))
    return out


def trees():
    draw = random.Random(4)
    common = ["", "// licence", "}", "x" * 90]

    def text():
        return [draw.choice(common) if draw.random() < 0.5 else f"line {draw.randrange(60)} é" for _ in range(draw.randrange(1, 25))]

    gone, came = {}, {}
    for i in range(60):
        lines = text()
        gone[f"old/{i:02}"] = "\n".join(lines)
        kept = [x for x in lines if draw.random() < 0.8] + [f"new {draw.randrange(9)}"] * draw.randrange(3)
        came[f"new/{draw.randrange(90):02}"] = "\n".join(kept)
    for i in range(6):  # copies on both sides, in different numbers
        gone[f"copy/{i}"] = "same\n" * 20
        came[f"copied/{i % 4}"] = "same\n" * 19 + "but one"
    gone |= {"empty": "", "none": None, "odd": "\n\n\n"}
    came |= {"void": "", "nothing": None, "even": "\n\n"}
    return gone, came


@pytest.mark.parametrize("least", [50, 80])
def test_edited_files_pair_up_as_all_pairs_tell(spark, least):
    gone, came = trees()
    found = renames.edited_renames(rows(spark, gone), rows(spark, came), least).collect()
    assert {(r["old_path"], r["path"]) for r in found} == greedy(gone, came, least)
    assert len(found) == len({r["old_path"] for r in found}) == len({r["path"] for r in found}) > 20
    assert all(r["similarity"] == similarity(gone[r["old_path"]], came[r["path"]])[1] for r in found)


def test_only_files_with_a_rare_line_in_common_are_compared(spark, monkeypatch):
    """A line that all files have pairs none of them, as long as it is not half of a file."""
    old = {f"a{i}": f"common\n{'own of a' * 3} {i}" for i in range(200)}
    new = {f"b{i}": f"common\n{'own of b' * 3} {i}" for i in range(200)} | {"c": "common\nown of a"}
    counts, plain = {}, renames.materialize

    def counted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(renames, "materialize", counted)
    assert renames.similar_contents(rows(spark, old), rows(spark, new)).count() == 0
    assert counts["candidate-renames"] == 0 and counts["common-lines"] == 1


def test_a_diff_knows_equal_edited_changed_and_new_files(spark):
    old = {"keep": "k", "edit": "1\n2\n3\n4", "move": "m\nn", "both": "a\nb\nc\nd\ne", "gone": "only here"}
    new = {"keep": "k", "edit": "1\n2\n3\nfour", "moved": "m\nn", "both2": "a\nb\nc\nd\nchanged", "came": "nothing alike"}
    found = {tuple(r) for r in incremental.diff_trees(rows(spark, old), rows(spark, new)).select("status", "path", "old_path").collect()}
    assert found == {("M", "edit", None), ("R", "moved", "move"), ("R", "both2", "both"), ("D", "gone", None), ("A", "came", None)}
    nothing = rows(spark, old).limit(0)
    assert {r["status"] for r in incremental.diff_trees(nothing, rows(spark, new)).collect()} == {"A"}
    assert incremental.diff_trees(nothing, nothing).count() == 0


def test_reasons_of_an_update():
    assert incremental.invalidation_reason(0, 0, 0) == "nothing to apply"
    assert incremental.invalidation_reason(2, 5, 1) == "2 file(s) changed; 5 file(s) in the region; 1 rule scope(s) invalidated"


def test_revisions_are_validated_and_empty_fields_are_absent(spark):
    from evgraph.operators import merge, validate

    good = spark.createDataFrame([("a", None, None, None, 1)], "sha string, parent string, at string, summary string, ordinal long")
    validate.assert_valid_revisions(good)
    with pytest.raises(ValueError, match="<anonymous>: revision.sha is required"):
        validate.assert_valid_revisions(good.selectExpr("'' AS sha", "parent", "at", "summary"))
    found = merge.record_revision(good, "b", "", "", "text").where("sha = 'b'").first()
    assert (found["parent"], found["at"], found["summary"], found["ordinal"]) == (None, None, "text", 2)

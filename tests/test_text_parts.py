"""Canonical text in parts."""

import hashlib

import pytest

from evgraph.functions import canonical, text_parts
from evgraph.sources import tabular

SF_DIR = "/root/testdata/sf0.001"


def whole(nodes, edges):
    return canonical.graph_document(nodes, edges).first()


@pytest.mark.parametrize("pieces,fan,partitions", [(1024, 1024, 4), (7, 3, 2), (1, 2, 5)])
def test_parts_are_the_document(spark, monkeypatch, pieces, fan, partitions):
    monkeypatch.setattr(text_parts, "PIECES", pieces)
    monkeypatch.setattr(text_parts, "FAN", fan)
    g = tabular.graph(spark, SF_DIR)
    nodes = g.nodes.where("kind IN ('project', 'module', 'file')").repartition(partitions)
    edges = g.edges.where("kind = 'contains' AND src LIKE 'project:%'").repartition(partitions)
    parts = text_parts.document_parts(nodes, edges)
    levels = text_parts.levels_over(parts)
    rows = parts.join(text_parts.starts(levels), "part").orderBy("part").collect()
    text = "".join(r.text for r in rows)
    want = whole(nodes, edges)
    assert text == want.json and hashlib.sha256(text.encode()).hexdigest() == want.hash
    size = 0
    for number, r in enumerate(rows):
        assert (r.part, r.start, r.bytes, r.sha256) == (number, size, len(r.text.encode()), hashlib.sha256(r.text.encode()).hexdigest())
        size += r.bytes
    hashes = [r.sha256 for r in rows]
    while True:
        hashes = [hashlib.sha256("\n".join(hashes[i : i + fan]).encode()).hexdigest() for i in range(0, len(hashes), fan)]
        if len(hashes) == 1:
            break
    assert tuple(text_parts.root_of(levels).first()) == (size, hashes[0])


def test_graphs_without_edges_or_nodes_and_repeated_records(spark):
    g = tabular.graph(spark, SF_DIR)
    nodes, edges = g.nodes.where("kind = 'project'"), g.edges.where("kind = 'contains' AND src LIKE 'project:%'")
    none = nodes.where("false"), edges.where("false")
    for n, e, text in ((none[0], none[1], '{"edges":[],"nodes":[]}'), (nodes, none[1], None), (none[0], edges, None), (nodes.unionByName(nodes), edges, None)):
        got = "".join(r.text for r in text_parts.document_parts(n, e).orderBy("part").collect())
        assert got == (text or whole(n, e).json)

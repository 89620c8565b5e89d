"""Queries on the graph: search, explain, adjacency, impact, neighbours. Each is one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions.columns import edge_record
from evgraph.operators.skew import split_join


def find(rows: DataFrame, **equals: str | None) -> DataFrame:
    """Rows that equal all of the given values; unknown columns don't count, null matches nothing."""
    for column, value in equals.items():
        if column in rows.columns:
            rows = rows.where(F.lit(False) if value is None else F.col(column) == value)
    return rows


def ladder(q: Column) -> Column:
    """How well a node matches a folded text, from 1000 for its exact name to 300 for a part of its file, else 0."""
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "qualified_name", "route", "file")}
    return (
        F.when(low["name"] == q, 1000).when(low["qualified_name"] == q, 950).when(low["route"] == q, 900)
        .when(F.startswith(low["name"], q), 800).when(F.contains(low["name"], q), 700)
        .when(F.startswith(low["qualified_name"], q), 600).when(F.contains(low["qualified_name"], q), 500)
        .when(F.contains(low["route"], q), 400).when(F.contains(low["file"], q), 300).otherwise(0)
    )


def score(query: str) -> Column:
    """``ladder`` of a query's text."""
    return ladder(F.lit(query.strip().lower()))


def search(nodes: DataFrame, query: str, limit: int = 25, kind: str | None = None) -> DataFrame:
    """The best ``limit`` nodes by score, then by id in Unicode order; a blank query finds nothing."""
    if not query.strip():
        return nodes.withColumn("score", F.lit(0)).where(F.lit(False))
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    hits = nodes.withColumn("score", score(query)).where("score > 0")
    return hits.orderBy(F.desc("score"), F.collate("id", "UNICODE"), "id").limit(limit)


def explain_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Each edge of a node with its ``direction``; a loop comes once in each. Nothing if the node is missing."""
    there = nodes.where(F.col("id") == node_id).select(F.col("id").alias("_node")).distinct()
    incoming = edges.where(F.col("dst") == node_id).withColumn("direction", F.lit("incoming"))
    outgoing = edges.where(F.col("src") == node_id).withColumn("direction", F.lit("outgoing"))
    both = incoming.unionByName(outgoing).withColumn("_end", F.lit(node_id))
    return both.join(there, F.col("_end") == F.col("_node"), "left_semi").drop("_end")


def derived_containment(nodes: DataFrame) -> DataFrame:
    """Edges from nodes to the file of their first evidence, if that is a node and not the node itself."""
    first = F.filter(F.coalesce("evidence", F.array()), lambda e: e["file"].isNotNull() & (e["line_start"] > 0))
    placed = nodes.where("kind <> 'repository'").withColumn("e", F.get(first, F.lit(0))).where("e IS NOT NULL")
    placed = placed.withColumn("to", F.concat(F.lit("file:"), F.col("e.file"))).where("id <> to")
    files = nodes.where("kind = 'file'").select(F.col("id").alias("to"))
    # a file may hold most of all nodes
    return split_join(placed, files, "to", ["id"], "left_semi").select(
        *edge_record(
            id=F.concat("id", F.lit("->"), "to", F.lit(":contains")), src=F.col("id"), dst=F.col("to"),
            kind=F.lit("contains"), nature=F.lit("INFERRED"), extractor=F.lit("query"), extractor_version=F.lit("0.1.0"),
            evidence=F.col("e"), observed_in_rev=F.col("last_seen_rev"), first_seen_rev=F.col("first_seen_rev"),
            last_seen_rev=F.col("last_seen_rev"),
        )
    )


def adjacency(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """``from_id``, ``to_id``, ``seq`` and ``edge_id``: each edge both ways, stored ones before derived ones.

    ``seq`` is the order in which a node's neighbours are visited. ``strict`` leaves out ids that are no nodes.
    """
    stored = edges.select(F.lit(0).alias("source"), "id", "src", "dst")
    derived = derived_containment(nodes).select(F.lit(1).alias("source"), "id", "src", "dst")
    both = stored.unionByName(derived)
    ways = F.explode(
        F.array(
            F.struct(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.lit(0).alias("way")),
            F.struct(F.col("dst").alias("from_id"), F.col("src").alias("to_id"), F.lit(1).alias("way")),
        )
    )
    arcs = both.withColumn("arc", ways).select(
        "arc.from_id", "arc.to_id", F.struct("source", F.col("id").alias("edge_id"), "arc.way").alias("seq"), F.col("id").alias("edge_id")
    )
    if strict:
        for end in ("from_id", "to_id"):
            arcs = arcs.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return arcs


def _touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in ``ids(id)``, once each."""
    ids = ids.select("id").distinct()
    marked = [edges.join(ids.select(F.col("id").alias(end)), end, "left_semi") for end in ("src", "dst")]
    other = marked[1].join(ids.select(F.col("id").alias("src")), "src", "left_anti")
    return marked[0].unionByName(other.select(*marked[0].columns)).select(*edges.columns)


def impact_file(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose primary place is in ``file``, and the edges among them."""
    hit = nodes.where(F.col("file") == file)
    ids = hit.select("id").distinct()
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return hit, edges


def impact_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """A node and its incoming, then outgoing edges; a loop comes twice."""
    incident = edges.where(F.col("dst") == node_id).unionAll(edges.where(F.col("src") == node_id))
    return nodes.where(F.col("id") == node_id), incident


def impact_kind(nodes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """All nodes of a kind, and the edges that touch any of them."""
    hit = nodes.where(F.col("kind") == kind)
    return hit, _touching(edges, hit)


def without_consumers(nodes: DataFrame, edges: DataFrame, kind: str = "endpoint", consumer_kind: str = "calls_endpoint") -> DataFrame:
    """Nodes of a kind that no edge of ``consumer_kind`` leads to."""
    used = edges.where(F.col("kind") == consumer_kind).select(F.col("dst").alias("id")).distinct()
    return nodes.where(F.col("kind") == kind).join(used, "id", "left_anti")


def impact(nodes: DataFrame, edges: DataFrame, target: str | dict) -> tuple[DataFrame, DataFrame, str | None]:
    """Nodes and edges that a target touches, and a reason if it is unknown.

    A string is a node's id if there is such a node, else a file. Of a dict's keys, ``without_consumers`` goes before
    ``file``, ``node_id`` and ``kind``.
    """
    nothing = nodes.where(F.lit(False)), edges.where(F.lit(False))
    if isinstance(target, str):
        known = nodes.where(F.col("id") == target).limit(1).count()
        return (*(impact_node if known else impact_file)(nodes, edges, target), None)
    if target.get("without_consumers"):
        kind, consumer = target.get("kind", "endpoint"), target.get("consumer_kind", "calls_endpoint")
        return without_consumers(nodes, edges, kind, consumer), nothing[1], None
    if target.get("file"):
        return (*impact_file(nodes, edges, target["file"]), None)
    if target.get("node_id"):
        if not nodes.where(F.col("id") == target["node_id"]).limit(1).count():
            return (*nothing, f"unknown node: {target['node_id']}")
        return (*impact_node(nodes, edges, target["node_id"]), None)
    if target.get("kind"):
        return (*impact_kind(nodes, edges, target["kind"]), None)
    return (*nothing, "unknown target")


def neighbors(nodes: DataFrame, edges: DataFrame, focus: DataFrame, mode: str = "expand") -> DataFrame:
    """For each ``focus(id)``: ``focus`` and ``id`` of the nodes one step away.

    ``upstream`` follows incoming edges, ``downstream`` outgoing ones, ``expand`` both; ``collapse`` gives
    the focus itself. The focus is not its own neighbour, and ids that are no nodes never show.
    """
    start = focus.select(F.col("id").alias("focus")).distinct()
    if mode == "collapse":
        found = start.select("focus", F.col("focus").alias("id"))
    else:
        steps = []
        if mode in ("expand", "upstream"):
            steps.append(edges.select(F.col("dst").alias("focus"), F.col("src").alias("id")))
        if mode in ("expand", "downstream"):
            steps.append(edges.select(F.col("src").alias("focus"), F.col("dst").alias("id")))
        arcs = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
        found = arcs.where("focus <> id").join(start, "focus", "left_semi").distinct()
    return found.join(nodes.select("id"), "id", "left_semi").select("focus", "id")


def contains_text(query: str) -> Column:
    """Whether a node's name, qualified name, id, route or file holds a text, whatever its case."""
    q = F.lit(query.strip().lower())
    found = F.lit(False)
    for c in ("name", "qualified_name", "id", "route", "file"):
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return found


def find_focus(nodes: DataFrame, text: str) -> DataFrame:
    """The node with this id, else the first by id whose qualified name or name it is."""
    hits = nodes.where((F.col("id") == text) | (F.col("qualified_name") == text) | (F.col("name") == text))
    return hits.orderBy(F.col("id") != text, "id").limit(1)


def kinds(rows: DataFrame) -> DataFrame:
    """Each kind that the nodes or edges have."""
    return rows.select("kind").distinct()


def evidence_of(edges: DataFrame, edge_id: str) -> DataFrame:
    """The evidence of an edge: ``file``, ``line_start``, ``line_end`` and ``rev``; no row if there is no such edge."""
    return edges.where(F.col("id") == edge_id).select("evidence.*")

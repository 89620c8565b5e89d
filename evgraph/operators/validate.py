"""Violations of the graph's rules, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.schema import EDGE_KINDS, NATURES, NODE_KINDS


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _unless(ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))


def _evidence_faults(e: Column, label: str = "") -> list[Column]:
    start, end = e["line_start"], e["line_end"]
    file = F.when(_blank(e["file"]), F.lit(f"{label}evidence.file is required")).when(
        F.contains(e["file"], F.lit("\\")), F.lit(f"{label}evidence.file must be a POSIX path")
    )
    last = F.when(end <= 0, F.lit(f"{label}evidence.lineEnd must be a positive integer")).when(
        (start > 0) & (end < start), F.lit(f"{label}evidence.lineEnd must be >= evidence.lineStart")
    )
    return [
        file, _unless(start > 0, f"{label}evidence.lineStart must be a positive integer"), last,
        F.when(_blank(e["rev"]), F.lit(f"{label}evidence.rev is required")),
    ]


def _required(prefix: str, columns: dict[str, str]) -> list[Column]:
    return [F.when(_blank(F.col(c)), F.lit(f"{prefix}.{name} is required")) for name, c in columns.items()]


def _rows(df: DataFrame, part: str, faults: list[Column], more: Column | None = None) -> DataFrame:
    found = F.filter(F.array(*faults), lambda m: m.isNotNull())
    found = found if more is None else F.concat(found, more)
    return df.select(F.lit(part).alias("part"), "id", F.explode(found).alias("violation"))


def validate_nodes(nodes: DataFrame) -> DataFrame:
    """All violations of all nodes: ``part``, ``id``, ``violation``."""
    faults = _required("node", {"id": "id"})
    faults.append(_unless(F.col("kind").isin(*NODE_KINDS), f"node.kind must be one of {', '.join(NODE_KINDS)}"))
    faults += _required("node", {"name": "name", "qualifiedName": "qualified_name", "firstSeenRev": "first_seen_rev", "lastSeenRev": "last_seen_rev"})
    faults.append(
        F.when(F.trim("file") == "", F.lit("node.file must be a non-empty string")).when(
            F.contains("file", F.lit("\\")), F.lit("node.file must be a POSIX path")
        )
    )
    faults.append(F.when(F.col("line_start") <= 0, F.lit("node.lineStart must be a positive integer")))
    none = F.array().cast("array<string>")
    pieces = F.transform(
        F.coalesce("evidence", F.array()),
        lambda e, i: F.transform(
            F.filter(F.array(*_evidence_faults(e)), lambda m: m.isNotNull()),
            lambda m: F.concat(F.lit("node.evidence["), i.cast("string"), F.lit("]: "), m),
        ),
    )
    return _rows(nodes, "node", faults, F.coalesce(F.flatten(pieces), none))


def validate_edges(edges: DataFrame) -> DataFrame:
    """All violations of all edges: ``part``, ``id``, ``violation``. No edge may lack evidence."""
    faults = _required("edge", {"id": "id", "src": "src", "dst": "dst"})
    faults.append(_unless(F.col("kind").isin(*EDGE_KINDS), f"edge.kind must be one of {', '.join(EDGE_KINDS)}"))
    faults.append(_unless(F.col("nature").isin(*NATURES), f"edge.nature must be one of {', '.join(NATURES)}"))
    faults += _required("edge", {"extractor": "extractor", "extractorVersion": "extractor_version"})
    missing = F.col("evidence").isNull()
    faults.append(F.when(missing, F.lit("edge.evidence is required")))
    faults += [F.when(~missing, m) for m in _evidence_faults(F.col("evidence"), "edge.")]
    faults += _required("edge", {"observedInRev": "observed_in_rev", "firstSeenRev": "first_seen_rev", "lastSeenRev": "last_seen_rev"})
    ruled = F.col("rule_id").isNotNull() & (F.col("nature") != "INFERRED")
    faults.append(F.when(ruled, F.lit("edge.ruleId requires nature INFERRED")))
    return _rows(edges, "edge", faults)


def validate_revisions(revisions: DataFrame) -> DataFrame:
    """All violations of revisions: ``part``, ``id`` (the sha), ``violation``. Absent fields are fine but for the sha, blank ones are not."""
    faults = _required("revision", {"sha": "sha"})
    faults += [F.when(F.trim(c) == "", F.lit(f"revision.{c} must be a non-empty string")) for c in ("parent", "at", "summary")]
    return _rows(revisions.withColumn("id", F.col("sha")), "revision", faults)


def assert_valid_revisions(revisions: DataFrame) -> None:
    """Raises with one violation, if there is any."""
    for row in validate_revisions(revisions).limit(1).collect():
        raise ValueError(f"revision {row['id'] or '<anonymous>'}: {row['violation']}")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations of nodes and edges, and ids that occur more than once."""
    twice = [
        duplicate_ids(df).select(F.lit(part).alias("part"), "id", F.lit(f"duplicate {part} id").alias("violation"))
        for part, df in (("node", nodes), ("edge", edges))
    ]
    return validate_nodes(nodes).unionByName(validate_edges(edges)).unionByName(twice[0]).unionByName(twice[1])


def assert_valid(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises with one violation, if there is any."""
    for row in validate_graph(nodes, edges).limit(1).collect():
        raise ValueError(f"{row['part']} {row['id']}: {row['violation']}")

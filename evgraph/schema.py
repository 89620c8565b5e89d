"""Records of the evidence graph, and the closed sets of their kinds."""

from __future__ import annotations

from pyspark.sql import types as T

# The kinds and natures that a graph may hold.
NATURES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
NODE_KINDS = (
    "repository", "project", "module", "namespace", "file", "type", "class", "interface", "method", "function",
    "endpoint", "route", "client", "component", "page", "binding", "binding_rule",
)
EDGE_KINDS = (
    "contains", "imports", "calls", "references", "inherits", "implements", "instantiates", "declares_endpoint",
    "calls_endpoint", "consumed_by", "routes_to", "binds_implementation", "generated_from",
)
ROLES = ("api", "ui", "lib")


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_S, _L = T.StringType(), T.LongType()

EVIDENCE = _struct(("file", _S, True), ("line_start", _L, True), ("line_end", _L, True), ("rev", _S, True))
NODE = _struct(
    ("id", _S, True), ("kind", _S, True), ("name", _S, True), ("qualified_name", _S, True), ("file", _S, True),
    ("line_start", _L, True), ("line_end", _L, True), ("route", _S, True), ("method", _S, True), ("scope", _S, True),
    ("first_seen_rev", _S, True), ("last_seen_rev", _S, True), ("evidence", T.ArrayType(EVIDENCE), True),
    ("metadata", T.MapType(_S, _S), True),
)
EDGE = _struct(
    ("id", _S, True), ("src", _S, True), ("dst", _S, True), ("kind", _S, True), ("nature", _S, True),
    ("extractor", _S, True), ("extractor_version", _S, True), ("evidence", EVIDENCE, True),
    ("observed_in_rev", _S, True), ("first_seen_rev", _S, True), ("last_seen_rev", _S, True), ("rule_id", _S, True),
    ("metadata", T.MapType(_S, _S), True),
)
REVISION = _struct(("sha", _S, True), ("parent", _S, True), ("at", _S, True), ("summary", _S, True), ("ordinal", _L, True))
FILE = _struct(("repo", _S, True), ("path", _S, True), ("content", _S, True), ("content_sha", _S, True), ("rev", _S, True))

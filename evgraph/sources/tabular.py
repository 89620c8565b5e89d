"""Star-schema tables as an evidence graph.

Regions are projects, nations modules, customers clients, suppliers classes, parts interfaces and orders
endpoints; each table is a file, a row's key plus 1 its line. Years are revisions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.functions.columns import edge_record, node_record
from evgraph.plans.shared import hadoop_path

FIRST_REV, LAST_REV = "Y1995", "Y2001"
EXTRACTOR, VERSION = "tabular", "0.1.0"
#: Bytes of a file whose rows may be broadcast; dictionaries make files many times smaller than their rows.
BROADCAST_BYTES = 1 << 19
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def year_rev(date: Column) -> Column:
    return F.concat(F.lit("Y"), F.year(date).cast("string"))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _large(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether a table may be too large for a broadcast, whatever Spark takes for its size."""
    p, fs = hadoop_path(spark, f"{sf_dir}/{name}.parquet")
    return fs.getContentSummary(p).getLength() > BROADCAST_BYTES


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region, 25 rows."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", "r_name", F.concat_ws(".", "r_name", "n_name").alias("nation_qn"), "n_name")


def _node(df: DataFrame, kind: str, file: str, key: str, name: Column, qn: Column, **more: Column) -> DataFrame:
    more = {"first_seen_rev": F.lit(FIRST_REV), "last_seen_rev": F.lit(LAST_REV)} | more
    return df.select(
        *node_record(
            kind=F.lit(kind), name=name, qualified_name=qn, file=F.lit(file), line_start=F.col(key).cast("long") + 1, **more
        )
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, t = F.col, lambda name: _read(spark, sf_dir, name)
    place = places(spark, sf_dir)
    files = spark.createDataFrame([(name,) for name in TABLES], "name string")
    in_nation = lambda df, key: df.join(place, col(key) == col("n_nationkey"))
    owned = lambda name: F.concat_ws(".", "nation_qn", name)
    rev = year_rev(col("o_orderdate"))
    method_route = F.concat(col("o_orderstatus"), F.lit(" /orders/"), col("o_orderkey").cast("string"))
    brand_name = F.concat_ws(".", "p_brand", "p_name")
    parts = [
        files.select(
            *node_record(
                kind=F.lit("file"), name=col("name"), qualified_name=col("name"), file=col("name"), line_start=F.lit(1),
                first_seen_rev=F.lit(FIRST_REV), last_seen_rev=F.lit(LAST_REV),
            )
        ),
        _node(t("region"), "project", "region", "r_regionkey", col("r_name"), col("r_name")),
        _node(place, "module", "nation", "n_nationkey", col("n_name"), col("nation_qn"), scope=col("r_name")),
        _node(in_nation(t("customer"), "c_nationkey"), "client", "customer", "c_custkey", col("c_name"), owned("c_name"), scope=col("nation_qn")),
        _node(in_nation(t("supplier"), "s_nationkey"), "class", "supplier", "s_suppkey", col("s_name"), owned("s_name"), scope=col("nation_qn")),
        _node(t("part"), "interface", "part", "p_partkey", brand_name, F.concat_ws(".", brand_name, col("p_partkey").cast("string"))),
        _node(
            t("orders"), "endpoint", "orders", "o_orderkey", method_route, method_route, method=col("o_orderstatus"),
            route=F.concat(F.lit("/orders/"), col("o_orderkey").cast("string")), first_seen_rev=rev, last_seen_rev=rev,
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def client_id() -> Column:
    return F.concat(F.lit("client:"), F.concat_ws(".", "nation_qn", "c_name"))


def endpoint_id() -> Column:
    return F.concat(F.lit("endpoint:"), F.col("o_orderstatus"), F.lit(" /orders/"), F.col("o_orderkey").cast("string"))


def part_id() -> Column:
    return F.concat(F.lit("interface:"), F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string")))


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge record per line item, order => part; ids may occur again. ``ordinal`` orders them over all columns."""
    col = F.col
    item = _read(spark, sf_dir, "lineitem")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    rows = item.join(orders, col("l_orderkey") == col("o_orderkey")).join(part, col("l_partkey") == col("p_partkey"))
    rev = year_rev(col("l_shipdate"))
    record = edge_record(
        src=endpoint_id(), dst=part_id(), kind=F.lit("references"), nature=F.lit("EXTRACTED"), extractor=F.lit(EXTRACTOR),
        extractor_version=F.lit(VERSION), file=F.lit("lineitem"), line_start=col("l_orderkey") * 8 + col("l_linenumber") + 1,
        observed_in_rev=rev, first_seen_rev=rev, last_seen_rev=rev,
        metadata=F.create_map(F.lit("flag"), col("l_returnflag"), F.lit("status"), col("l_linestatus")),
    )
    ordinal = F.struct("l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return rows.select(*record, ordinal.alias("ordinal"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, t = F.col, lambda name: _read(spark, sf_dir, name)
    place = places(spark, sf_dir)

    def edge(df: DataFrame, src: Column, dst: Column, kind: str, file: str, line: Column, first: Column, last: Column) -> DataFrame:
        return df.select(
            *edge_record(
                src=src, dst=dst, kind=F.lit(kind), nature=F.lit("EXTRACTED"), extractor=F.lit(EXTRACTOR),
                extractor_version=F.lit(VERSION), file=F.lit(file), line_start=line, observed_in_rev=last, first_seen_rev=first,
                last_seen_rev=last,
            )
        )

    first, last = F.lit(FIRST_REV), F.lit(LAST_REV)
    module = F.concat(F.lit("module:"), col("nation_qn"))
    customer = t("customer").join(place, col("c_nationkey") == col("n_nationkey"))
    supplier = t("supplier").join(place, col("s_nationkey") == col("n_nationkey"))
    supplier_id = F.concat(F.lit("class:"), F.concat_ws(".", "nation_qn", "s_name"))
    rev = year_rev(col("o_orderdate"))
    large = {name: _large(spark, sf_dir, name) for name in ("customer", "supplier", "part", "orders")}
    side = lambda df, name: df.hint("merge") if large[name] else df
    # rows that are joined by a key are dealt by it before they are grouped by that key and others, so that they move once
    dealt = lambda key, name: t("lineitem").repartition(key) if large[name] else t("lineitem")
    order, part = t("orders").select("o_orderkey", "o_orderstatus"), t("part").select("p_partkey", "p_brand", "p_name")
    calls = t("orders").join(side(customer, "customer"), col("o_custkey") == col("c_custkey"))
    shipped = [year_rev(f("l_shipdate")).alias(name) for f, name in ((F.min, "first"), (F.max, "last"))]
    supplied = dealt("l_partkey", "part").groupBy("l_suppkey", "l_partkey").agg(
        (F.min(col("l_orderkey") * 8 + col("l_linenumber")) + 1).alias("line"), *shipped
    )
    supplied = supplied.join(side(part, "part"), col("l_partkey") == col("p_partkey")).join(
        side(supplier, "supplier"), col("l_suppkey") == col("s_suppkey")
    )
    # line items of the same order, part and line are one edge; numbers make the key, so that this is a hash aggregation
    referred = dealt("l_orderkey", "orders").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(*shipped)
    referred = referred.join(side(order, "orders"), col("l_orderkey") == col("o_orderkey")).join(
        side(part, "part"), col("l_partkey") == col("p_partkey")
    )
    line = col("l_orderkey") * 8 + col("l_linenumber") + 1
    parts = [
        edge(place, F.concat(F.lit("project:"), col("r_name")), module, "contains", "nation", col("n_nationkey").cast("long") + 1, first, last),
        edge(customer, module, client_id(), "contains", "customer", col("c_custkey") + 1, first, last),
        edge(supplier, module, supplier_id, "contains", "supplier", col("s_suppkey") + 1, first, last),
        edge(calls, client_id(), endpoint_id(), "calls_endpoint", "orders", col("o_orderkey") + 1, rev, rev),
        edge(supplied, supplier_id, part_id(), "implements", "lineitem", col("line"), col("first"), col("last")),
        edge(referred, endpoint_id(), part_id(), "references", "lineitem", line, col("first"), col("last")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of orders and shipments, in order; each one's parent is the one before."""
    from pyspark.sql import Window

    dates = _read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).unionByName(
        _read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"))
    )
    # one row per year
    by_year = Window.orderBy("y")
    return dates.distinct().select(
        F.concat(F.lit("Y"), F.col("y").cast("string")).alias("sha"),
        F.lag(F.concat(F.lit("Y"), F.col("y").cast("string"))).over(by_year).alias("parent"),
        F.lit(None).cast("string").alias("at"), F.lit(None).cast("string").alias("summary"),
        F.row_number().over(by_year).cast("long").alias("ordinal"),
    )


def at_revision(graph: Graph, rev: str) -> Graph:
    """The graph as of a revision: edges seen by then, and all nodes."""
    return Graph(graph.nodes, graph.edges.where(F.col("first_seen_rev") <= rev))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of the files ``u{user}``: ``path``, ``status``, ``event_id``."""
    event = _read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "purchase", "R").otherwise("M")
    return event.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), status.alias("status"), "event_id", "event_type", "ts")

"""Queries over the tables as an evidence graph, each beside the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.functions import canonical
from evgraph.functions import columns as C
from evgraph.operators import graph as G
from evgraph.operators import incremental as I
from evgraph.operators import merge as M
from evgraph.operators import paths as P
from evgraph.operators import resolve as R
from evgraph.operators import validate as V
from evgraph.plans import render
from evgraph.sources import contracts, tabular
from evgraph.streaming import upsert as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The graph of ``evgraph.sources.tabular`` in SQL.
GRAPH_SQL = """
WITH place AS (
  SELECT n_nationkey, r_name, n_name, r_name || '.' || n_name AS nation_qn FROM nation JOIN region ON n_regionkey = r_regionkey
), item AS (
  SELECT *, l_orderkey * 8 + l_linenumber + 1 AS line, 'Y' || year(l_shipdate) AS rev FROM lineitem
), p AS (
  SELECT *, p_brand || '.' || p_name AS brand_name, 'interface:' || p_brand || '.' || p_name || '.' || p_partkey AS part_id FROM part
), o AS (
  SELECT *, 'endpoint:' || o_orderstatus || ' /orders/' || o_orderkey AS order_id, 'Y' || year(o_orderdate) AS rev FROM orders
), c AS (
  SELECT *, 'client:' || nation_qn || '.' || c_name AS client_id FROM customer JOIN place ON c_nationkey = n_nationkey
), s AS (
  SELECT *, 'class:' || nation_qn || '.' || s_name AS class_id FROM supplier JOIN place ON s_nationkey = n_nationkey
), nodes AS (
  SELECT 'file:' || f AS id, 'file' AS kind, f AS name, f AS qualified_name, f AS file, 1::BIGINT AS line_start, NULL AS route,
    NULL AS method, NULL AS scope, 'Y1995' AS first_seen_rev, 'Y2001' AS last_seen_rev
  FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem']) AS f)
  UNION ALL SELECT 'project:' || r_name, 'project', r_name, r_name, 'region', r_regionkey + 1, NULL, NULL, NULL, 'Y1995', 'Y2001' FROM region
  UNION ALL SELECT 'module:' || nation_qn, 'module', n_name, nation_qn, 'nation', n_nationkey + 1, NULL, NULL, r_name, 'Y1995', 'Y2001' FROM place
  UNION ALL SELECT client_id, 'client', c_name, nation_qn || '.' || c_name, 'customer', c_custkey + 1, NULL, NULL, nation_qn, 'Y1995', 'Y2001' FROM c
  UNION ALL SELECT class_id, 'class', s_name, nation_qn || '.' || s_name, 'supplier', s_suppkey + 1, NULL, NULL, nation_qn, 'Y1995', 'Y2001' FROM s
  UNION ALL SELECT part_id, 'interface', brand_name, brand_name || '.' || p_partkey, 'part', p_partkey + 1, NULL, NULL, NULL, 'Y1995', 'Y2001' FROM p
  UNION ALL SELECT order_id, 'endpoint', o_orderstatus || ' /orders/' || o_orderkey, o_orderstatus || ' /orders/' || o_orderkey, 'orders',
    o_orderkey + 1, '/orders/' || o_orderkey, o_orderstatus, NULL, rev, rev FROM o
), links AS (
  SELECT 'project:' || r_name AS src, 'module:' || nation_qn AS dst, 'contains' AS kind, 'nation' AS file, n_nationkey + 1 AS line,
    'Y1995' AS first_seen_rev, 'Y2001' AS last_seen_rev FROM place
  UNION ALL SELECT 'module:' || nation_qn, client_id, 'contains', 'customer', c_custkey + 1, 'Y1995', 'Y2001' FROM c
  UNION ALL SELECT 'module:' || nation_qn, class_id, 'contains', 'supplier', s_suppkey + 1, 'Y1995', 'Y2001' FROM s
  UNION ALL SELECT client_id, order_id, 'calls_endpoint', 'orders', o_orderkey + 1, rev, rev FROM o JOIN c ON o_custkey = c_custkey
  UNION ALL SELECT class_id, part_id, 'implements', 'lineitem', min(line), min(rev), max(rev)
    FROM item JOIN s ON l_suppkey = s_suppkey JOIN p ON l_partkey = p_partkey GROUP BY class_id, part_id
  UNION ALL SELECT order_id, part_id, 'references', 'lineitem', line, min(item.rev), max(item.rev)
    FROM item JOIN o ON l_orderkey = o_orderkey JOIN p ON l_partkey = p_partkey GROUP BY order_id, part_id, line
), edges AS (
  SELECT src || '->' || dst || ':' || kind || '@' || file || ':' || line AS id, src, dst, kind, 'EXTRACTED' AS nature,
    file AS ev_file, line::BIGINT AS ev_line, first_seen_rev, last_seen_rev FROM links
), derived AS (
  SELECT n.id || '->file:' || n.file || ':contains' AS id, n.id AS src, 'file:' || n.file AS dst FROM nodes n WHERE n.id <> 'file:' || n.file
), arcs AS (
  SELECT source, e.id AS edge_id, way, CASE way WHEN 0 THEN src ELSE dst END AS from_id, CASE way WHEN 0 THEN dst ELSE src END AS to_id
  FROM (SELECT 0 AS source, id, src, dst FROM edges UNION ALL SELECT 1, id, src, dst FROM derived) e, (VALUES (0), (1)) ways(way)
)
"""
NODE_COLUMNS = ["id", "kind", "name", "qualified_name", "file", "line_start", "route", "method", "scope", "first_seen_rev", "last_seen_rev"]
NODES_SQL, EDGES_SQL = ", ".join(NODE_COLUMNS), "id, src, dst, kind, nature, ev_file, ev_line, first_seen_rev, last_seen_rev"


def query(sql: str | None = None, graph: bool = True) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL; ``graph`` puts the graph's tables in front."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (GRAPH_SQL if graph else "") + sql
        return f

    return add


def flat_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(*NODE_COLUMNS)


def flat_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        "id", "src", "dst", "kind", "nature", F.col("evidence.file").alias("ev_file"), F.col("evidence.line_start").alias("ev_line"),
        "first_seen_rev", "last_seen_rev",
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans


@query(f"SELECT {NODES_SQL} FROM nodes WHERE kind = 'endpoint' AND method = 'F'")
def scan_find_nodes(spark, sf_dir):
    return flat_nodes(G.find(tabular.nodes(spark, sf_dir), kind="endpoint", method="F"))


@query(f"SELECT {EDGES_SQL} FROM edges WHERE kind = 'implements' AND nature = 'EXTRACTED'")
def scan_get_edges(spark, sf_dir):
    return flat_edges(G.find(tabular.edges(spark, sf_dir), kind="implements", nature="EXTRACTED"))


YEARS_SQL = """years AS (
  SELECT DISTINCT y FROM (SELECT year(o_orderdate) AS y FROM orders UNION ALL SELECT year(l_shipdate) FROM lineitem)
)"""


@query(
    f"WITH {YEARS_SQL} SELECT 'Y' || y AS sha, 'Y' || lag(y) OVER (ORDER BY y) AS parent, row_number() OVER (ORDER BY y) AS ordinal FROM years",
    graph=False,
)
def scan_revisions(spark, sf_dir):
    return tabular.revisions(spark, sf_dir).select("sha", "parent", "ordinal")


@query(f"WITH {YEARS_SQL} SELECT 'Y' || max(y) AS sha FROM years", graph=False)
def last_revision(spark, sf_dir):
    return M.last_revision(tabular.revisions(spark, sf_dir))


@query("SELECT 'node' AS part, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def counts_by_kind(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    count = F.count(F.lit(1)).alias("n")
    return g.nodes.groupBy(F.lit("node").alias("part"), "kind").agg(count).unionByName(
        g.edges.groupBy(F.lit("edge").alias("part"), "kind").agg(count)
    )


# Merges


@query("""
SELECT id, src, dst, ev_line, CASE WHEN first_seen_rev <= 'Y1997' THEN first_seen_rev ELSE 'Y1998' END AS first_seen_rev,
  CASE WHEN last_seen_rev >= 'Y1998' THEN 'Y2002' ELSE last_seen_rev END AS last_seen_rev,
  CASE WHEN last_seen_rev >= 'Y1998' THEN 'Y2002' ELSE last_seen_rev END AS observed_in_rev
FROM edges WHERE kind = 'implements'
""")
def upsert_merge(spark, sf_dir):
    """Supplies known by 1997 are stored; those seen later come as a batch at revision Y2002."""
    edges = tabular.edges(spark, sf_dir).where("kind = 'implements'")
    batch = edges.where("last_seen_rev >= 'Y1998'").withColumn("first_seen_rev", F.lit("Y1998")).withColumn("ordinal", F.lit(1))
    merged = M.upsert(edges.where("first_seen_rev <= 'Y1997'"), batch, "Y2002")
    return merged.select("id", "src", "dst", F.col("evidence.line_start").alias("ev_line"), "first_seen_rev", "last_seen_rev", "observed_in_rev")


REFERENCE_SQL = """, rows AS (
  SELECT order_id || '->' || part_id || ':references@lineitem:' || line AS id, item.rev, l_returnflag AS flag, l_linestatus AS status,
    row_number() OVER w AS pos, count(*) OVER (PARTITION BY order_id, part_id, line) AS n
  FROM item JOIN o ON l_orderkey = o_orderkey JOIN p ON l_partkey = p_partkey
  WINDOW w AS (PARTITION BY order_id, part_id, line
    ORDER BY l_shipdate, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)
)"""


@query(REFERENCE_SQL + """
SELECT id, max(flag) FILTER (pos = n) AS flag, max(status) FILTER (pos = n) AS status, max(rev) FILTER (pos = 1) AS first_seen_rev,
  max(rev) FILTER (pos = n) AS last_seen_rev FROM rows GROUP BY id
""")
def upsert_last_wins(spark, sf_dir):
    rows = tabular.reference_rows(spark, sf_dir)
    stored = rows.drop("ordinal").where(F.lit(False))
    merged = M.upsert(stored, rows)
    return merged.select("id", F.col("metadata.flag").alias("flag"), F.col("metadata.status").alias("status"), "first_seen_rev", "last_seen_rev")


@query(REFERENCE_SQL + "SELECT id, count(*) AS n FROM rows GROUP BY id HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    return V.duplicate_ids(tabular.reference_rows(spark, sf_dir))


GONE_SQL = "SELECT id FROM nodes WHERE kind = 'module' AND scope = 'ASIA'"


@query(f"SELECT id, src, dst FROM edges WHERE src NOT IN ({GONE_SQL}) AND dst NOT IN ({GONE_SQL})")
def remove_cascade(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    gone = G.find(g.nodes, kind="module", scope="ASIA").select("id")
    return M.remove_nodes(g.nodes, g.edges, gone)[1].select("id", "src", "dst")


@query(f"SELECT id, src, dst FROM edges WHERE src IN ({GONE_SQL}) OR dst IN ({GONE_SQL})")
def remove_only(spark, sf_dir):
    """The edges that are left without an end when nodes go without their edges."""
    g = tabular.graph(spark, sf_dir)
    gone = G.find(g.nodes, kind="module", scope="ASIA").select("id")
    nodes, edges = M.remove_nodes(g.nodes, g.edges, gone, cascade=False)
    return M.dangling_edges(nodes, edges).select("id", "src", "dst")


@query("""
SELECT part_id AS id, row_number() OVER (PARTITION BY part_id ORDER BY line) AS place, line::BIGINT AS ev_line
FROM (SELECT DISTINCT part_id, line FROM item JOIN p ON l_partkey = p_partkey)
""")
def merge_evidence(spark, sf_dir):
    """One node per part, with a piece of evidence for each line that sells it."""
    return merged_parts(spark, sf_dir).select("id", F.posexplode("evidence").alias("pos", "e")).select(
        "id", (F.col("pos") + 1).cast("long").alias("place"), F.col("e.line_start").alias("ev_line")
    )


def sold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each line item, as an extractor would give them: the same ids again and again."""
    item = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    rev = tabular.year_rev(F.col("l_shipdate"))
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber") + 1
    brand_name = F.concat_ws(".", "p_brand", "p_name")
    record = C.node_record(
        id=tabular.part_id(), kind=F.lit("interface"), name=brand_name,
        qualified_name=F.concat_ws(".", brand_name, F.col("p_partkey").cast("string")),
        file=F.concat(F.lit("lineitem/"), rev), line_start=line, first_seen_rev=rev, last_seen_rev=rev,
    )
    rows = item.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*record, line.alias("ordinal"), F.col("l_returnflag").alias("flag"))


def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sold_parts(spark, sf_dir).drop("flag")
    same_file = F.transform("evidence", lambda e: e.withField("file", F.lit("lineitem")))
    return M.merge_nodes(rows.withColumn("evidence", same_file))


@query("SELECT part_id AS id, 'lineitem' AS file, min(line)::BIGINT AS line_start FROM item JOIN p ON l_partkey = p_partkey GROUP BY part_id")
def primary_location(spark, sf_dir):
    place = M.primary_location(F.col("evidence"))
    return merged_parts(spark, sf_dir).select("id", place["file"].alias("file"), place["line_start"].alias("line_start"))


# Resolution


INDEX_SQL = ", idx AS (SELECT name, count(DISTINCT id) AS ids, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM nodes WHERE kind = 'interface' GROUP BY name)"


@query(INDEX_SQL + "SELECT name, ids, id FROM idx")
def type_index(spark, sf_dir):
    return R.type_index(G.find(tabular.nodes(spark, sf_dir), kind="interface"))


def named_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier with the names of the parts that it sells; names are cut from every third on, so that some mean nothing."""
    item, part = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), table(spark, sf_dir, "part")
    rows = item.join(part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat_ws(".", "p_brand", "p_name")
    wanted = F.when(F.col("l_partkey") % 3 == 0, F.concat(name, F.lit("?"))).otherwise(name)
    return rows.select("l_suppkey", wanted.alias("wanted")).distinct()


WANTED_SQL = INDEX_SQL + """, refs AS (
  SELECT DISTINCT l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN brand_name || '?' ELSE brand_name END AS wanted
  FROM item JOIN p ON l_partkey = p_partkey)"""


@query(WANTED_SQL + "SELECT l_suppkey, wanted, id AS target FROM refs JOIN idx ON wanted = name WHERE ids = 1")
def resolve_unique(spark, sf_dir):
    index = R.type_index(G.find(tabular.nodes(spark, sf_dir), kind="interface"))
    return R.resolve_unique(named_references(spark, sf_dir), index, "wanted", spread=["l_suppkey"])


@query(WANTED_SQL + "SELECT l_suppkey, wanted, coalesce(ids, 0) AS ids FROM refs LEFT JOIN idx ON wanted = name WHERE ids IS NULL OR ids <> 1")
def resolve_ambiguous(spark, sf_dir):
    index = R.type_index(G.find(tabular.nodes(spark, sf_dir), kind="interface"))
    return R.ambiguous(named_references(spark, sf_dir), index, "wanted")


@query("""
SELECT event_id, method, route FROM (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'o' WHEN 'click' THEN 'F' ELSE 'P' END AS method, '/orders/' || user_id AS route FROM events)
WHERE upper(method) || ' ' || route IN (SELECT method || ' ' || route FROM nodes WHERE kind = 'endpoint')
""")
def semi_declared_routes(spark, sf_dir):
    method = F.when(F.col("event_type") == "view", "o").when(F.col("event_type") == "click", "F").otherwise("P")
    route = F.concat(F.lit("/orders/"), F.col("user_id").cast("string"))
    calls = table(spark, sf_dir, "events").select("event_id", method.alias("method"), route.alias("route"))
    return R.calls_of_declared_routes(calls, R.declared_routes(tabular.nodes(spark, sf_dir)))


@query("""
SELECT id, m.qualified_name AS scope FROM nodes n JOIN (SELECT qualified_name FROM nodes WHERE kind IN ('project', 'module')) m
  ON n.scope = m.qualified_name OR starts_with(n.scope, m.qualified_name || '.') WHERE n.scope IS NOT NULL
""")
def scope_files(spark, sf_dir):
    nodes = tabular.nodes(spark, sf_dir)
    scopes = nodes.where("kind IN ('project', 'module')").select(F.col("qualified_name").alias("scope"))
    members = nodes.where("scope IS NOT NULL").select("id", F.col("scope").alias("namespace"))
    return R.in_scope(members, scopes, "namespace").select("id", "scope")


# Graph queries


SCORE_SQL = """CASE WHEN lower(name) = '{q}' THEN 1000 WHEN lower(qualified_name) = '{q}' THEN 950 WHEN lower(coalesce(route, '')) = '{q}' THEN 900
  WHEN starts_with(lower(name), '{q}') THEN 800 WHEN contains(lower(name), '{q}') THEN 700
  WHEN starts_with(lower(qualified_name), '{q}') THEN 600 WHEN contains(lower(qualified_name), '{q}') THEN 500
  WHEN contains(lower(coalesce(route, '')), '{q}') THEN 400 WHEN contains(lower(file), '{q}') THEN 300 ELSE 0 END"""


def _ranked(hits: DataFrame) -> DataFrame:
    order = Window.orderBy(F.desc("score"), F.collate("id", "UNICODE"), "id")  # over the few hits of a search
    return hits.select("id", F.col("score").cast("long").alias("score"), F.row_number().over(order).cast("long").alias("rank"))


@query(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id COLLATE en, id) AS rank FROM (SELECT id, {SCORE_SQL.format(q='supplier')} AS score FROM nodes) WHERE score > 0 ORDER BY score DESC, id COLLATE en, id LIMIT 25")
def search_topk(spark, sf_dir):
    return _ranked(G.search(tabular.nodes(spark, sf_dir), " Supplier "))


@query(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id COLLATE en, id) AS rank FROM (SELECT id, {SCORE_SQL.format(q='asia')} AS score FROM nodes WHERE kind = 'module') WHERE score > 0 ORDER BY score DESC, id COLLATE en, id LIMIT 25")
def search_kind(spark, sf_dir):
    return _ranked(G.search(tabular.nodes(spark, sf_dir), "asia", kind="module"))


@query("SELECT 'incoming' AS direction, id, src, dst FROM edges WHERE dst = 'module:EUROPE.NATION_3' UNION ALL SELECT 'outgoing', id, src, dst FROM edges WHERE src = 'module:EUROPE.NATION_3'")
def explain_edges(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return G.explain_node(g.nodes, g.edges, "module:EUROPE.NATION_3").select("direction", "id", "src", "dst")


@query("SELECT from_id, to_id, source, edge_id, way FROM arcs")
def adjacency(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return G.adjacency(g.nodes, g.edges).select("from_id", "to_id", "seq.source", "edge_id", "seq.way")


ORPHANS_SQL = "SELECT id FROM nodes WHERE kind = 'interface' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'implements' AND first_seen_rev <= 'Y1995')"


@query(ORPHANS_SQL)
def orphans(spark, sf_dir):
    """Parts that no supplier sold in the first year."""
    g = tabular.at_revision(tabular.graph(spark, sf_dir), "Y1995")
    return G.without_consumers(g.nodes, g.edges, "interface", "implements").select("id")


def _impact(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    return found[0].select(F.lit("node").alias("part"), "id").unionAll(found[1].select(F.lit("edge").alias("part"), "id"))


@query("SELECT 'node' AS part, id FROM nodes WHERE file = 'nation' UNION ALL SELECT 'edge', id FROM edges WHERE src IN (SELECT id FROM nodes WHERE file = 'nation') AND dst IN (SELECT id FROM nodes WHERE file = 'nation')")
def impact_file(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return _impact(G.impact_file(g.nodes, g.edges, "nation"))


@query("SELECT 'node' AS part, id FROM nodes WHERE id = 'module:ASIA.NATION_2' UNION ALL SELECT 'edge', id FROM edges WHERE dst = 'module:ASIA.NATION_2' UNION ALL SELECT 'edge', id FROM edges WHERE src = 'module:ASIA.NATION_2'")
def impact_node(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return _impact(G.impact_node(g.nodes, g.edges, "module:ASIA.NATION_2"))


@query("SELECT 'node' AS part, id FROM nodes WHERE kind = 'class' UNION ALL SELECT 'edge', id FROM edges WHERE starts_with(src, 'class:') OR starts_with(dst, 'class:')")
def impact_kind(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return _impact(G.impact_kind(g.nodes, g.edges, "class"))


def _neighbors(mode: str) -> Query:
    def run(spark, sf_dir):
        g = tabular.graph(spark, sf_dir)
        return G.neighbors(g.nodes, g.edges, g.nodes.where("kind IN ('module', 'class')"), mode)

    run.__name__ = f"neighbors_{mode}"
    return run


FOCUS_SQL = "WHERE focus <> id AND focus IN (SELECT id FROM nodes WHERE kind IN ('module', 'class')) AND id IN (SELECT id FROM nodes)"
UP_SQL, DOWN_SQL = "SELECT dst AS focus, src AS id FROM edges", "SELECT src AS focus, dst AS id FROM edges"
for _mode, _sql in {
    "upstream": f"SELECT DISTINCT focus, id FROM ({UP_SQL}) {FOCUS_SQL}",
    "downstream": f"SELECT DISTINCT focus, id FROM ({DOWN_SQL}) {FOCUS_SQL}",
    "expand": f"SELECT DISTINCT focus, id FROM ({UP_SQL} UNION ALL {DOWN_SQL}) {FOCUS_SQL}",
    "collapse": "SELECT id AS focus, id FROM nodes WHERE kind IN ('module', 'class')",
}.items():
    query(_sql)(_neighbors(_mode))


@query(f"SELECT id, kind FROM nodes WHERE contains(lower(name), 'brand#1') OR contains(lower(qualified_name), 'brand#1') OR contains(lower(id), 'brand#1') OR contains(lower(coalesce(route, '')), 'brand#1') OR contains(lower(file), 'brand#1')")
def viewer_filter(spark, sf_dir):
    return tabular.nodes(spark, sf_dir).where(G.contains_text("Brand#1")).select("id", "kind")


@query("SELECT id FROM nodes WHERE id = 'NATION_3' OR name = 'NATION_3' OR qualified_name = 'NATION_3' ORDER BY id <> 'NATION_3', id LIMIT 1")
def find_focus(spark, sf_dir):
    return G.find_focus(tabular.nodes(spark, sf_dir), "NATION_3").select("id")


@query("""
SELECT n.id, n.name, n.kind, n.file || ':' || n.line_start AS location,
  coalesce((SELECT string_agg(coalesce(m.name, e.src), ', ' ORDER BY coalesce(m.name, e.src)) FROM edges e LEFT JOIN nodes m ON m.id = e.src WHERE e.dst = n.id), '') AS upstream,
  coalesce((SELECT string_agg(coalesce(m.name, e.dst), ', ' ORDER BY coalesce(m.name, e.dst)) FROM edges e LEFT JOIN nodes m ON m.id = e.dst WHERE e.src = n.id), '') AS downstream
FROM nodes n WHERE n.kind IN ('project', 'module')
""")
def viewer_list(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return render.viewer_rows(g.nodes, g.edges, g.nodes.where("kind IN ('project', 'module')"))


START, END = "project:ASIA", "project:EUROPE"
#: Levels of the search in SQL, which has no loop; more than the graph of the tables is deep.
DEPTH = 10


def _bfs_sql(levels: int) -> str:
    """Breadth-first search, one table per level, as a queue would go: by the parent's place, then the arc's."""
    sql = f", l0 AS (SELECT '{START}' AS id, 1::BIGINT AS place, []::VARCHAR[] AS edges, []::INT[] AS ways, 0 AS depth), v0 AS (SELECT id FROM l0)"
    for k in range(1, levels + 1):
        sql += f""", l{k} AS (
  SELECT id, row_number() OVER (ORDER BY place, source, edge_id, way) AS place, list_append(edges, edge_id) AS edges, list_append(ways, way) AS ways, {k} AS depth
  FROM (SELECT to_id AS id, place, source, edge_id, way, edges, ways,
      row_number() OVER (PARTITION BY to_id ORDER BY place, source, edge_id, way) AS nth
    FROM l{k - 1} JOIN arcs ON from_id = id WHERE to_id NOT IN (SELECT id FROM v{k - 1}))
  WHERE nth = 1), v{k} AS (SELECT id FROM v{k - 1} UNION ALL SELECT id FROM l{k})"""
    return sql


@query(_bfs_sql(DEPTH) + " ".join(f"{'UNION ALL ' if k else ''}SELECT id, depth::BIGINT AS distance FROM l{k}" for k in range(DEPTH + 1)))
def bfs_distance(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    # distances need no edges' ids, and both joins of a level say what is broadcast
    arcs = P.materialize(G.adjacency(g.nodes, g.edges).select("from_id", "to_id"), "arcs", "zstd")
    return P.distances(arcs, START)


@query(_bfs_sql(DEPTH) + ", hit AS (" + " UNION ALL ".join(f"SELECT edges, ways FROM l{k} WHERE id = '{END}'" for k in range(DEPTH + 1)) + """)
SELECT unnest(range(1, len(edges) + 1)) AS hop, unnest(edges) AS edge_id, unnest(ways) = 0 AS forward FROM hit""")
def bfs_path(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    arcs = P.materialize(G.adjacency(g.nodes, g.edges).select("from_id", "to_id", "seq"), "arcs")
    return P.shortest_path(g.nodes, arcs, START, END)


# Maintenance


def sharded_files(graph: tabular.Graph) -> tabular.Graph:
    """The graph with a file for each nation's customers and each year's orders, and a rule for each region."""
    nation = F.element_at(F.split("qualified_name", r"\."), 2)
    file = F.when(F.col("kind") == "client", F.concat(F.lit("customer/"), nation)).otherwise(F.concat(F.lit("orders/"), "first_seen_rev"))
    nodes = graph.nodes.where("kind IN ('client', 'endpoint')").withColumn("file", file)
    nodes = nodes.withColumn("evidence", F.array(C.evidence(F.col("file"), F.col("line_start"), F.col("last_seen_rev"))))
    calls = graph.edges.where("kind = 'calls_endpoint'")
    calls = calls.withColumn("evidence", F.col("evidence").withField("file", F.concat(F.lit("orders/"), "first_seen_rev")))
    rules = graph.nodes.where("kind = 'project'").select(
        *C.node_record(
            kind=F.lit("binding_rule"), name=F.lit("scan"), qualified_name=F.concat("name", F.lit(":scan")), file=F.lit("rules"),
            line_start=F.col("line_start"), scope=F.col("name"), rev=F.col("last_seen_rev"),
        )
    )
    return tabular.Graph(nodes.unionByName(rules), calls)


def _changed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("customer/NATION_2",), ("orders/Y1999",)], "file string")


@query("""
, files AS (SELECT unnest(['customer/NATION_2', 'orders/Y1999']) AS file), spaces AS (SELECT DISTINCT 'customer/' || n_name AS file, nation_qn AS namespace FROM c),
places AS (SELECT id, CASE kind WHEN 'client' THEN 'customer/' || split_part(qualified_name, '.', 2) ELSE 'orders/' || first_seen_rev END AS file
  FROM nodes WHERE kind IN ('client', 'endpoint')),
changed AS (SELECT id FROM places WHERE file IN (SELECT file FROM files)),
reasons AS (
  SELECT file, 0 AS rank FROM files
  UNION ALL SELECT 'orders/' || first_seen_rev, 1 FROM edges WHERE kind = 'calls_endpoint' AND (src IN (SELECT id FROM changed) OR dst IN (SELECT id FROM changed))
  UNION ALL SELECT s2.file, 2 FROM files f JOIN spaces s1 ON s1.file = f.file JOIN region r ON starts_with(s1.namespace, r.r_name || '.')
    JOIN spaces s2 ON starts_with(s2.namespace, r.r_name || '.'))
SELECT file, ['changed', 'dependent', 'scope'][min(rank) + 1] AS reason FROM reasons GROUP BY file
""")
def region(spark, sf_dir):
    g = sharded_files(tabular.graph(spark, sf_dir))
    spaces = g.nodes.where("kind = 'client'").select("file", F.col("scope").alias("namespace")).distinct()
    return I.region(g.nodes, g.edges, _changed(spark), spaces)


@query("""
SELECT DISTINCT 'binding_rule:' || r_name || ':scan' AS id, r_name AS scope, 'rules' AS file FROM c WHERE n_name = 'NATION_2'
""")
def invalidated_rules(spark, sf_dir):
    g = sharded_files(tabular.graph(spark, sf_dir))
    spaces = g.nodes.where("kind = 'client'").select("file", F.col("scope").alias("namespace")).distinct()
    return I.invalidated_rules(g.nodes, _changed(spark), spaces)


DIFF_SQL = """
WITH old AS (
  SELECT 'u' || user_id AS path, sha256(string_agg(event_type, ',' ORDER BY event_id)) AS sha FROM events WHERE event_id % 2 = 0 GROUP BY user_id
), new AS (
  SELECT 'u' || user_id AS path, sha256(string_agg(event_type, ',' ORDER BY event_id)) AS sha FROM events WHERE event_id % 2 = 1 GROUP BY user_id
), gone AS (
  SELECT path, sha, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM old WHERE path NOT IN (SELECT path FROM new)
), came AS (
  SELECT path, sha, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM new WHERE path NOT IN (SELECT path FROM old)
)
SELECT 'M' AS status, path, NULL AS old_path FROM old JOIN new USING (path) WHERE old.sha <> new.sha
UNION ALL SELECT CASE WHEN gone.path IS NULL THEN 'A' WHEN came.path IS NULL THEN 'D' ELSE 'R' END, coalesce(came.path, gone.path),
  CASE WHEN came.path IS NOT NULL THEN gone.path END FROM gone FULL JOIN came ON gone.sha = came.sha AND gone.n = came.n
"""


@query(DIFF_SQL, graph=False)
def diff_status(spark, sf_dir):
    """Two listings of the files ``u{user}``: what even and odd events say of each user."""
    events = tabular.change_log(spark, sf_dir)

    def listing(odd: int) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
        text = F.array_join(F.transform(ordered, lambda e: e["event_type"]), ",")
        return events.where(F.col("event_id") % 2 == odd).groupBy("path").agg(F.sha2(text, 256).alias("content_sha"))

    return I.diff_snapshots(listing(0), listing(1))


@query("""
SELECT id, CASE file WHEN 'supplier' THEN 'vendors' ELSE file END AS file, CASE file WHEN 'supplier' THEN 'vendors' ELSE file END AS ev_file, first_seen_rev
FROM nodes WHERE kind IN ('class', 'client')
""")
def rename_remap(spark, sf_dir):
    nodes = tabular.nodes(spark, sf_dir).where("kind IN ('class', 'client')")
    renames = spark.createDataFrame([("supplier", "vendors")], "old_path string, path string")
    moved = I.remap_renames(nodes, renames)
    return moved.select("id", "file", F.get("evidence", F.lit(0))["file"].alias("ev_file"), "first_seen_rev")


RECONCILE_SQL = """
, sold AS (SELECT part_id AS id, rev, line, l_returnflag AS flag, row_number() OVER (PARTITION BY part_id, rev, line) AS nth FROM item JOIN p ON l_partkey = p_partkey),
stored AS (SELECT DISTINCT id, rev, line FROM sold WHERE rev IN ('Y1995', 'Y1996')),
fresh AS (SELECT DISTINCT id, rev, line FROM sold WHERE rev = 'Y1996' AND flag = 'R' UNION SELECT DISTINCT id, rev, line FROM sold WHERE rev = 'Y1997'),
ids AS (SELECT id FROM stored UNION SELECT id FROM fresh),
facts AS (SELECT id, id IN (SELECT id FROM stored) AS old, id IN (SELECT id FROM fresh) AS again,
  id IN (SELECT id FROM stored WHERE rev = 'Y1996') AS hit, id IN (SELECT id FROM stored WHERE rev <> 'Y1996') AS outside,
  (SELECT count(*) FROM stored s WHERE s.id = ids.id) AS n_old, (SELECT count(*) FROM stored s WHERE s.id = ids.id AND s.rev <> 'Y1996') AS n_out,
  (SELECT count(*) FROM fresh f WHERE f.id = ids.id) AS n_fresh FROM ids)
SELECT id, CASE WHEN NOT old THEN 'added' WHEN again THEN 'refreshed' WHEN NOT hit THEN 'kept' WHEN outside THEN 'reduced' ELSE 'removed' END AS action,
  CASE WHEN NOT old THEN n_fresh WHEN again THEN n_out + n_fresh WHEN NOT hit THEN n_old WHEN outside THEN n_out ELSE n_old END AS pieces FROM facts
"""


@query(RECONCILE_SQL)
def reconcile(spark, sf_dir):
    """Parts sold in two years are stored; of the second only returned lines are found again, and a third year is new."""
    rows = sold_parts(spark, sf_dir)
    year = F.element_at(F.split("file", "/"), 2)
    stored = M.merge_nodes(rows.where(year.isin("Y1995", "Y1996")).drop("flag"))
    fresh = M.merge_nodes(rows.where(((year == "Y1996") & (F.col("flag") == "R")) | (year == "Y1997")).drop("flag"))
    files = spark.createDataFrame([("lineitem/Y1996",), ("lineitem/Y1997",)], "file string")
    return I.reconcile_nodes(stored, fresh, files).select("id", "action", F.size("evidence").cast("long").alias("pieces"))


@query("""
SELECT path, status FROM (SELECT 'u' || user_id AS path, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'R' ELSE 'M' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth = 1
""", graph=False)
def stream_upsert(spark, sf_dir):
    """The change log as a stream of files, merged batch by batch."""

    def prepare(batch: DataFrame) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "purchase", "R").otherwise("M")
        return batch.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), status.alias("status"), "event_id")

    log = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    home = stream.fresh_path(spark, "change-log")
    log.repartition(4, "event_id").write.parquet(home)
    found = stream.follow(spark, home, "event_id long, user_id long, event_type string", prepare, "path", "event_id")
    return found.select("path", "status")


# Documents


@query("SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value FROM events", graph=False)
def json_operations(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("key", "value"))


@query("SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY event_type, key", graph=False)
def json_keys(spark, sf_dir):
    keys = F.explode(F.json_object_keys("props"))
    return table(spark, sf_dir, "events").select("event_type", keys.alias("key")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'endpoint:' || verb || ' /' || lower(n_name) AS id, verb AS method, '/' || lower(n_name) AS route, 'spec/' || r_name || '.json' AS file
FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('GET'), ('POST')) v(verb)
""", graph=False)
def openapi_operations(spark, sf_dir):
    """A contract for each region, with two operations for each nation and parts that are none."""
    place = tabular.places(spark, sf_dir)
    item = F.concat(F.lit('"/'), F.lower("n_name"), F.lit('":{"get":{},"Post":{"x":1},"parameters":[],"summary":"s"}'))
    paths = place.groupBy("r_name").agg(F.array_join(F.collect_list(item), ",").alias("paths"))
    files = paths.select(
        F.concat(F.lit("spec/"), "r_name", F.lit(".json")).alias("path"), F.lit("r1").alias("rev"),
        F.concat(F.lit('{"openapi":"3.0.0","paths":{'), "paths", F.lit("}}")).alias("content"),
    )
    broken = files.withColumn("content", F.lit("{")).withColumn("path", F.concat("path", F.lit(".broken")))
    return contracts.openapi_endpoints(files.unionByName(broken)).select("id", "method", "route", "file")


@query("""
SELECT page_id, pos AS place, href FROM (
  SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages))
""", graph=False)
def imports_html(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs).alias("pos", "href"))
    return found.select("page_id", (F.col("pos") + 1).cast("long").alias("place"), "href")


@query("""
SELECT p_partkey, regexp_replace(regexp_replace('src/' || replace(p_type, ' ', '/') || '/x.ts', '/[^/]*$', ''), '/[^/]*$', '') || '/lib/' || p_partkey AS resolved FROM part
""", graph=False)
def resolve_relative(spark, sf_dir):
    file = F.concat(F.lit("src/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/x.ts"))
    spec = F.concat(F.lit("../lib/./y/../"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", C.resolve_relative(file, spec).alias("resolved"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '/api/' || o_orderstatus || '/{id}' END AS route FROM orders", graph=False)
def route_template(spark, sf_dir):
    part = lambda text, name: F.struct(F.lit(text).cast("string").alias("text"), F.lit(name).cast("string").alias("name"))
    parts = F.array(part("/api/", None), part(None, "STATUS"), part("/", None), part(None, "id"))
    broken = F.array_append(parts, part(None, None))
    constants = F.create_map(F.lit("STATUS"), F.col("o_orderstatus"))
    route = C.route_from_parts(F.when(F.col("o_orderstatus") == "P", broken).otherwise(parts), constants)
    return table(spark, sf_dir, "orders").select("o_orderkey", route.alias("route"))


@query("SELECT id, trim(regexp_replace(lower(method || ' ' || route), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nodes WHERE kind = 'endpoint'")
def slugify(spark, sf_dir):
    return tabular.nodes(spark, sf_dir).where("kind = 'endpoint'").select("id", C.slugify(F.col("route"), F.col("method")).alias("slug"))


CANONICAL_SQL = """, texts AS (
  SELECT 'node' AS part, id, '{"evidence":[{"file":"' || file || '","lineStart":' || line_start || '}],"file":"' || file || '","id":"' || id ||
    '","kind":"' || kind || '","lineStart":' || line_start || coalesce(',"method":"' || method || '"', '') || ',"name":"' || name ||
    '","qualifiedName":"' || qualified_name || '"' || coalesce(',"route":"' || route || '"', '') || coalesce(',"scope":"' || scope || '"', '') || '}' AS json FROM nodes
  UNION ALL SELECT 'edge', id, '{"dst":"' || dst || '","evidence":{"file":"' || ev_file || '","lineStart":' || ev_line ||
    '},"extractor":"tabular","extractorVersion":"0.1.0","id":"' || id || '","kind":"' || kind || '","nature":"' || nature || '","src":"' || src || '"}' FROM edges
)"""


@query(CANONICAL_SQL + "SELECT part, id, json, sha256(json) AS sha256 FROM texts")
def canonical_rows(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return canonical.canonical_rows(g.nodes, g.edges)


@query(CANONICAL_SQL + """, hashed AS (SELECT part, sha256(json) AS sha FROM texts),
buckets AS (SELECT ('0x' || substr(sha, 1, 8))::BIGINT % 4096 AS bucket, sha256(string_agg(part || ':' || sha, chr(10) ORDER BY part || ':' || sha)) AS h FROM hashed GROUP BY 1)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, sha256(string_agg(bucket || ':' || h, chr(10) ORDER BY bucket)) AS hash FROM buckets
""")
def graph_hash(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return canonical.graph_hash(g.nodes, g.edges)


@query("""
, bad AS (SELECT order_id || '->' || part_id || ':references@lineitem:' || line AS id, l_linenumber, l_returnflag FROM item JOIN o ON l_orderkey = o_orderkey JOIN p ON l_partkey = p_partkey)
SELECT id, 'edge.evidence.lineStart must be a positive integer' AS violation FROM bad WHERE l_linenumber < 3
UNION ALL SELECT id, 'edge.ruleId requires nature INFERRED' FROM bad WHERE l_returnflag = 'R'
UNION ALL SELECT id, 'duplicate edge id' FROM bad GROUP BY id HAVING count(*) > 1
""")
def validate_violations(spark, sf_dir):
    """Line items as edges, spoilt in two ways."""
    edges = tabular.reference_rows(spark, sf_dir).drop("ordinal")
    number = F.pmod(F.col("evidence.line_start") - 1, F.lit(8))
    edges = edges.withColumn("evidence", F.col("evidence").withField("line_start", number - 2))
    edges = edges.withColumn("rule_id", F.when(F.col("metadata.flag") == "R", F.lit("rule")))
    nodes = tabular.nodes(spark, sf_dir)
    return V.validate_graph(nodes, edges).select("id", "violation")


@query("""
, lines AS (SELECT *, '- ' || src || ' --[' || kind || ' ' || nature || ']--> ' || dst || '  @ ' || ev_file || ':' || ev_line AS line FROM edges)
SELECT n.id, trim(regexp_replace(lower(method || ' ' || route), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  '# Route: ' || qualified_name || chr(10) || 'revision: Y2001' || chr(10) || 'method: ' || method || chr(10) || 'route: ' || route || chr(10) ||
  'endpoint: ' || n.id || ' @ ' || file || ':' || line_start || chr(10) || chr(10) || '## consumers' || chr(10) || coalesce(i.t, '- (none)') || chr(10) || chr(10) ||
  '## outgoing' || chr(10) || coalesce(o2.t, '- (none)') || chr(10) AS text
FROM nodes n LEFT JOIN (SELECT dst, string_agg(line, chr(10) ORDER BY id COLLATE en) AS t FROM lines GROUP BY dst) i ON i.dst = n.id
  LEFT JOIN (SELECT src, string_agg(line, chr(10) ORDER BY id COLLATE en) AS t FROM lines GROUP BY src) o2 ON o2.src = n.id WHERE n.route IS NOT NULL
""")
def route_context(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return render.route_documents(g.nodes, g.edges, "Y2001")


@query("""
SELECT 'nodes/' || kind AS section, id, '- ' || id || ' @ ' || file || ':' || line_start || ' [' || first_seen_rev || '..' || last_seen_rev || ']' AS line FROM nodes
UNION ALL SELECT 'edges', id, '- ' || src || ' --[' || kind || ' ' || nature || ']--> ' || dst || '  @ ' || ev_file || ':' || ev_line || ' (' || last_seen_rev || ')' FROM edges
""")
def graph_context(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return render.context_lines(g.nodes, g.edges)


# Scalars


@query(r"""
SELECT p_partkey, 'a/' || p_brand || '/b' AS posix, p_brand || ' ' || p_partkey AS trimmed, 'part:' || p_brand || ' ' || p_partkey AS node_id,
  p_brand || '.' || p_name AS qualified, p_brand AS namespace, split_part(p_name, '.', -1) AS simple, p_name AS base,
  'src/' || p_name AS below, '.' AS itself, '/other/' || p_name AS elsewhere, '\u003cb>' || p_brand AS html
FROM part
""", graph=False)
def scalar_names(spark, sf_dir):
    c = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    brand, name, key, root = F.col("p_brand"), F.col("p_name"), F.col("p_partkey").cast("string"), F.lit("/repo")
    blanks = c("  ", brand, " \t\n ", key, " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.posix_path(c("a\\", brand, "\\b")).alias("posix"), C.normalize_id(blanks).alias("trimmed"),
        C.node_id(F.lit("part"), blanks).alias("node_id"), C.qualify(brand, F.lit(""), F.lit(None), name).alias("qualified"),
        C.namespace_of(c(brand, ".X")).alias("namespace"), C.simple_name(c("A.B.", name, "<int>")).alias("simple"),
        C.basename(c("a/b/", name)).alias("base"), C.relativize_path(c("/repo/src/", name), root).alias("below"),
        C.relativize_path(root, root).alias("itself"), C.relativize_path(c("/other/", name), root).alias("elsewhere"),
        C.json_for_html(c("<b>", brand)).alias("html"),
    )


@query("""
SELECT n_nationkey, true AS itself, true AS below, true AS folded, n_nationkey % 2 = 0 AS up, false AS beside, false AS above FROM nation
""", graph=False)
def is_within(spark, sf_dir):
    name, root = F.col("n_name"), F.concat(F.lit("/repo/"), "n_name")
    path = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    sometimes = F.when(F.col("n_nationkey") % 2 == 0, path("/repo/", name, "/a/../b")).otherwise(path("/repo/", name, "/a/../../b"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", C.is_within(root, root).alias("itself"), C.is_within(root, path(root, "/x/y")).alias("below"),
        C.is_within(root, path(root, "/x/../y/.")).alias("folded"), C.is_within(root, sometimes).alias("up"),
        C.is_within(root, path(root, "2/x")).alias("beside"), C.is_within(root, F.lit("/repo")).alias("above"),
    )


@query("SELECT DISTINCT 'node' AS part, kind FROM nodes UNION ALL SELECT DISTINCT 'edge', kind FROM edges")
def distinct_kinds(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return G.kinds(g.nodes).select(F.lit("node").alias("part"), "kind").unionByName(G.kinds(g.edges).select(F.lit("edge").alias("part"), "kind"))


SUPPLY = "(SELECT min(id) FROM edges WHERE kind = 'implements')"


@query(f"SELECT ev_file AS file, ev_line AS line_start FROM edges WHERE id = {SUPPLY}")
def edge_evidence(spark, sf_dir):
    edges = tabular.edges(spark, sf_dir)
    first = edges.where("kind = 'implements'").agg(F.min("id")).first()[0]
    return G.evidence_of(edges, first).select("file", "line_start")


@query(f"SELECT id FROM edges WHERE kind = 'implements' AND id <> {SUPPLY}")
def remove_edge(spark, sf_dir):
    edges = tabular.edges(spark, sf_dir).where("kind = 'implements'")
    return M.remove_edges(edges, edges.agg(F.min("id").alias("id"))).select("id")


@query("""
, shown AS (SELECT e.*, coalesce(a.name, e.src) || ' --[' || e.kind || ' ' || nature || ']--> ' || coalesce(b.name, e.dst) || '  @ ' || ev_file || ':' || ev_line AS line
  FROM edges e LEFT JOIN nodes a ON a.id = e.src LEFT JOIN nodes b ON b.id = e.dst)
SELECT n.id, 'node' AS section, unnest(list_filter([
  'id: ' || id, 'kind: ' || kind, 'name: ' || name, 'qualified_name: ' || qualified_name, 'file: ' || file, 'line_start: ' || line_start,
  'route: ' || route, 'method: ' || method, 'scope: ' || scope, 'first_seen_rev: ' || first_seen_rev, 'last_seen_rev: ' || last_seen_rev
], lambda x: x IS NOT NULL)) AS line FROM nodes n
UNION ALL SELECT dst, 'incoming', line FROM shown WHERE dst IN (SELECT id FROM nodes)
UNION ALL SELECT src, 'outgoing', line FROM shown WHERE src IN (SELECT id FROM nodes)
""")
def node_details(spark, sf_dir):
    g = tabular.graph(spark, sf_dir)
    return render.detail_lines(g.nodes, g.edges)


@query("""
SELECT id, file, file AS ev_file FROM nodes WHERE kind IN ('class', 'client')
""")
def relativize(spark, sf_dir):
    """Suppliers and customers as if scanned below ``/checkout``, and brought back."""
    g = tabular.graph(spark, sf_dir)
    below = lambda c: F.concat(F.lit("/checkout/"), c)
    nodes = g.nodes.where("kind IN ('class', 'client')").withColumn("file", below(F.col("file")))
    nodes = nodes.withColumn("evidence", F.transform("evidence", lambda e: e.withField("file", below(e["file"]))))
    moved, _ = canonical.relativize_graph(nodes, g.edges.where("kind = 'implements'"), "/checkout")
    return moved.select("id", "file", F.get("evidence", F.lit(0))["file"].alias("ev_file"))


SOLD_SQL = ", sold AS (SELECT DISTINCT part_id AS id, 'lineitem/' || rev AS file FROM item JOIN p ON l_partkey = p_partkey)"


@query(SOLD_SQL + """
SELECT id FROM sold WHERE file IN ('lineitem/Y1995', 'lineitem/Y1996') GROUP BY id HAVING bool_or(file <> 'lineitem/Y1996')
""")
def drop_deleted(spark, sf_dir):
    """Parts sold in two years, of which the file of the second is deleted."""
    rows = sold_parts(spark, sf_dir).where(F.col("file").isin("lineitem/Y1995", "lineitem/Y1996")).drop("flag")
    return I.drop_deleted(M.merge_nodes(rows), spark.createDataFrame([("lineitem/Y1996",)], "file string")).select("id")


@query("""
SELECT id FROM edges WHERE kind = 'calls_endpoint' AND (first_seen_rev <> 'Y1999' OR ev_line % 2 = 0)
""")
def reconcile_stale_edges(spark, sf_dir):
    """Calls of one year's file are looked for again; those on odd lines are not found."""
    stored = sharded_files(tabular.graph(spark, sf_dir)).edges
    fresh = stored.where("evidence.file = 'orders/Y1999' AND evidence.line_start % 2 = 0")
    return I.reconcile_edges(stored, fresh, spark.createDataFrame([("orders/Y1999",)], "file string")).select("id")


@query("SELECT DISTINCT file, regexp_replace(qualified_name, '[.]?[^.]*$', '') AS namespace FROM nodes WHERE kind IN ('class', 'interface')")
def file_namespaces(spark, sf_dir):
    return R.namespaces_by_file(tabular.nodes(spark, sf_dir))


@query("""
SELECT 'binding_rule:' || r_name || ':scan' AS id, r_name AS scope, count(*) AS pieces FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""", graph=False)
def merge_rules(spark, sf_dir):
    """A registration in each nation's file; those of a region are one rule."""
    seen = tabular.places(spark, sf_dir).select(
        F.col("r_name").alias("assembly"), F.lit("scan").alias("call"), F.col("n_name").alias("file"), F.lit(1).alias("line"), F.col("n_name").alias("ordinal")
    )
    nodes = R.binding_rules(seen, F.lit("r1"))
    merged = M.merge_nodes(nodes.withColumn("ordinal", F.monotonically_increasing_id()))
    return merged.select("id", "scope", F.size("evidence").cast("long").alias("pieces"))

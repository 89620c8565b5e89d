"""Each query against its SQL in DuckDB."""

import duckdb
import pytest

import evgraph.change_queries  # noqa: F401, registers its queries
import evgraph.path_queries  # noqa: F401, likewise
import evgraph.source_queries  # noqa: F401, likewise
from evgraph.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(tuple(str(v) for v in row) for row in frame.where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)

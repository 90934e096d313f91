"""The queries that have SQL, against DuckDB."""

import duckdb
import pytest

from quillon.llm.oracle import ORACLE_SQL
from quillon.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    own, other = QUERIES[name](spark, FOLDER), con.sql(ORACLE_SQL[name])
    names = sorted(own.columns)
    assert names == sorted(other.columns)
    at = [other.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in own.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in other.fetchall()), key=str)

"""Every query that has SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from quillon.catalog import QUERIES
from quillon.oracle import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.8g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    own, other = QUERIES[name](spark, FOLDER), duck.sql(ORACLE_SQL[name])
    assert sorted(own.columns) == sorted(other.columns)
    names = sorted(own.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in own.collect()), key=str)
    at = [other.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(
            x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(
                x, y, rel_tol=1e-6, abs_tol=2e-6
            )
            for x, y in zip(a, b, strict=True)
        ), (a, b)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"screen", "bars"} <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() >= 0

"""Every query with an oracle: Spark result == DuckDB result on sf0.001
(row count, column names, order-insensitive value hash)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sitesift.catalog import ORACLE, QUERIES
from scripts.oracle_check import TABLES, digest, dtype_class


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.sql(E.oracle_sql()[name]).df()
    assert digest(sp) == digest(dk)
    assert {c: dtype_class(sp[c].dtype) for c in sp.columns} == {c: dtype_class(dk[c].dtype) for c in dk.columns}


def test_every_query_has_oracle_or_reason():
    assert set(QUERIES) - set(ORACLE) == {"stream_dedup"}

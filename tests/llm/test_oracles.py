"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from scripts.oracle_check import TABLES, digest, dtype_class
from sitesift.llm.oracles import ORACLE
from sitesift.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    sp, dk = QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLE[name]).df()
    assert digest(sp) == digest(dk)
    assert {c: dtype_class(sp[c].dtype) for c in sp.columns} == {c: dtype_class(dk[c].dtype) for c in dk.columns}

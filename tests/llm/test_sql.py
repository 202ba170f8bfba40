"""Every query of the subpackage that has a DuckDB statement gives the same rows as that statement."""

import glob
import os

import duckdb
import pytest

from tilewright.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_statement(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(sql.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert want and sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want

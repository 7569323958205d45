"""Queries that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from lectern.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)

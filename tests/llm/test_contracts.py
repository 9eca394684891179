"""What SQL can state of the operators, against DuckDB."""

import duckdb
import pytest

from fernweave.llm.contracts import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_part(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = [tuple(r) for r in want.select(*(duckdb.ColumnExpression(c) for c in df.columns)).fetchall()]
    key = lambda row: [(x is None, x if x is not None else 0) for x in row]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rows, key=key)

import os

import pytest

from readloom.llm import queries as llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query_runs_and_matches_its_sql(spark, name):
    import duckdb

    df = llm.queries()[name](spark, DATA)
    rows = df.collect()
    sql = llm.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    rel = con.sql(sql)
    order = sorted(df.columns)
    shown = lambda rs, cols: sorted(tuple(repr(r[cols.index(c)]) for c in order) for r in rs)
    assert order == sorted(rel.columns)
    assert shown(rows, df.columns) == shown(rel.fetchall(), rel.columns)

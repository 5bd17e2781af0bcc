import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def core_names():
    from readloom.plans import core_queries, read_queries, store_queries

    return sorted({**core_queries.queries(), **read_queries.queries(), **store_queries.queries()})


@pytest.mark.parametrize("name", core_names())
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    shown = lambda rs, cols: sorted(tuple(repr(r[cols.index(c)]) for c in order) for r in rs)
    assert shown(rows, df.columns) == shown(rel.fetchall(), rel.columns)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns and entry.entry(spark).count() >= 0


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
OWN = [n for plan in entry._PLANS for n in plan.QUERIES if n in plan.ORACLES]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN[::4])
def test_queries_against_sql(spark, name):
    """A quarter of the queries, over the smallest tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framelake.operators import index, reports

from .test_entry import SF, TABLES


def test_packet_names(spark):
    rows = [(0x62, 0x02, "[S334-1] Data broadcast (DTV) in VANC space"), (0x62, 0x03, "[RP208] VBI Data in VANC space"), (0xE0, 9, "[ST 299-1] Audio data in HANC space (HDTV)"), (0x01, 1, None), (0x81, 1, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "did int, sdid int, name string").select("name", reports.packet_name(F.col("did"), F.col("sdid")).alias("got"))
    assert all(r.name == r.got for r in df.collect())


def test_constant_segments_in_load_order(spark):
    rows = [(1, 0, 0, 10), (1, 1, 5, 10), (1, 2, 10, 10), (2, 0, 3, 1), (2, 1, 0, 5), (3, 0, 0, 0), (3, 1, 0, 5), (4, 0, 0, 4), (4, 1, 9, 1), (4, 2, 4, 1)]
    df = spark.createDataFrame(rows, "file int, load_order int, start_position int, duration int").repartition(3)
    got = {(r.file, r.load_order): r.status for r in index.merge_constant_segments(df, "file").collect()}
    assert [got[a, b] for a, b, _, _ in rows] == ["kept", "ignored", "kept", "sparse", "unread", "kept", "ignored", "kept", "sparse", "unread"]


@pytest.mark.parametrize("name", ["w15_merge_constant", "b5_packet_names"])
def test_rewritten_queries(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall()) and len({r.split(",")[-1] for r in rows}) > 1

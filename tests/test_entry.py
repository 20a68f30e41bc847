import os

import pytest

import __spark_entry__ as entry
from millrace.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_contract():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) == set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"seg", "n", "s"} == set(rows[0].asDict())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
@pytest.mark.parametrize("name", ["join_full", "in_query_under_or", "agg_sum_empty", "union_chain", "expr_int_div", "dml_update"])
def test_against_duckdb(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    df = QUERIES[name](spark, SMALL)
    assert df.columns == want.columns
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


def test_streaming(spark, tmp_path):
    from millrace.engine import Engine
    from millrace.streaming import stream_select, write_stream

    spark.createDataFrame([(1, 5.0), (2, None), (3, 7.5)], "id long, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v double").parquet(str(tmp_path / "in"))
    out = stream_select(Engine(spark), "s", stream, "SELECT id, v * 2 AS w FROM s WHERE NOT v = 5")
    q = write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(2, None), (3, 15.0)]

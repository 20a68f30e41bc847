"""Several engines on one root, numbers by partition, merging of parts, and the order of managed rows."""

import threading

import pytest

from millrace.engine import Engine
from millrace.sources import catalog


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, tmp_path)


def test_engines_on_one_root_lose_nothing(spark, tmp_path):
    one, two = Engine(spark, tmp_path), Engine(spark, tmp_path)
    one.sql("CREATE TABLE a (id INT)")
    two.sql("CREATE TABLE b (id INT)")
    assert one.catalog.list_tables() == two.catalog.list_tables() == ["a", "b"]

    def work(n):
        mine = Engine(spark, tmp_path)
        for i in range(3):
            mine.sql(f"INSERT INTO a VALUES ({10 * n + i})")

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(one.catalog.read_rows("a")) == [(10 * n + i,) for n in range(3) for i in range(3)]


def test_a_failed_change_leaves_no_trace(db):
    db.script("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1)")
    with pytest.raises(Exception):
        db.catalog.replace("t", db.catalog.read("t"), lambda: db.catalog._m["tables"].pop("t") and 1 / 0)
    assert db.catalog.read_rows("t") == [(1,)]


def test_numbers_over_partitions(spark, db):
    db.register("many", spark.range(0, 50, 1, 7).selectExpr("id", "if(id % 10 = 3, 100 + id, null) as own"))
    db.script("CREATE TABLE t (n INT AUTO_INCREMENT, id INT); INSERT INTO t SELECT own, id FROM many; INSERT INTO t VALUES (NULL, 99)")
    rows = db.catalog.read_rows("t")
    assert [i for _, i in rows] == [*range(50), 99]
    given = iter(range(1, 60))
    assert [n for n, _ in rows] == [100 + i if i % 10 == 3 else next(given) for i in [*range(50), 99]]
    assert db.catalog.read_rows_by_numbers("t", [0, 8, 49, 50, 51, 8]) == [rows[i] for i in (0, 8, 49, 50)]
    db.sql("DELETE FROM t WHERE id < 9")
    assert db.catalog.read_rows_by_numbers("t", [0, 41]) == [rows[9], rows[50]]


def test_small_parts_merge(db, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_PARTS", 4)
    db.script("CREATE TABLE t (id INT); INSERT INTO t VALUES " + ", ".join(f"({i})" for i in range(50)))
    large = db.catalog._table("t")["parts"][0]
    for i in range(6):
        db.sql(f"INSERT INTO t VALUES ({100 + i})")
    parts = db.catalog._table("t")["parts"]
    assert large in parts and len(parts) <= 4
    assert db.catalog.read_rows("t") == [(i,) for i in [*range(50), *range(100, 106)]]


def test_order_of_managed_rows(db):
    db.script("CREATE TABLE t (id INT, s VARCHAR); INSERT INTO t VALUES (5, 'a'), (3, 'b'), (5, 'a'), (9, 'c'); CREATE TABLE u (id INT); INSERT INTO u VALUES (4), (3), (8)")
    assert db.sql("SELECT id FROM t UNION ALL SELECT id FROM u").rows() == [(5,), (3,), (5,), (9,), (4,), (3,), (8,)]
    assert db.sql("SELECT id FROM u UNION SELECT id FROM t").rows() == [(4,), (3,), (8,), (5,), (9,)]
    assert db.sql("SELECT id, (SELECT s FROM t) AS x FROM u").rows() == [(4, "a"), (3, "a"), (8, "a")]
    assert db.sql("SELECT AVG(DISTINCT id) AS a, SUM(DISTINCT id) AS s FROM t").rows() == [(17 / 3, 17)]
    assert db.sql("SELECT AVG(DISTINCT id) AS a FROM t WHERE id > 99").rows() == [(None,)]


def test_indexes_have_bloom_filters(spark, db, tmp_path):
    import pyarrow.parquet as pq

    db.script("CREATE TABLE t (id INT, s VARCHAR); INSERT INTO t VALUES (1, 'a'), (2, 'b'); CREATE INDEX i ON t (s); INSERT INTO t VALUES (3, 'b')")
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert files and all(pq.ParquetFile(f).metadata.num_columns == 3 for f in files)
    assert sorted(tuple(r) for r in db.catalog.lookup_index("i", "b").collect()) == [(2, "b"), (3, "b")]
    plan = db.catalog.lookup_index("i", "b")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualNullSafe(s,b)]" in plan

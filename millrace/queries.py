"""Named queries of the engine over the driver's tables, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.__main__ import repl
from millrace.engine import Engine, scratch_root
from millrace.errors import ColumnCountMismatch, DuplicateKey, ForeignKeyViolation, IndexAlreadyExists, NullConstraint, TableAlreadyExists, TypeMismatch
from millrace.sources.rowtext import import_folder
from millrace.streaming import stream_select, write_stream

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels", "pages", "benchmark", "embeddings")

#: name: (the engine's SQL, DuckDB's SQL or None where it is the same text)
SELECTS: dict[str, tuple[str, str | None]] = {
    "join_agg_flagship": (
        "SELECT c.c_mktsegment AS seg, COUNT(*) AS n, SUM(o.o_totalprice) AS s FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"
        " WHERE o.o_totalprice > 1000 GROUP BY c.c_mktsegment HAVING COUNT(*) > 10",
        "SELECT c.c_mktsegment AS seg, COUNT(*) AS n, SUM(o.o_totalprice) AS s FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"
        " WHERE o.o_totalprice > 1000 GROUP BY c.c_mktsegment HAVING COUNT(*) > 10",
    ),
    "scan_project": ("SELECT n_name AS name, n_regionkey FROM nation", None),
    "scan_star": ("SELECT * FROM supplier", None),
    "scan_alias": ("SELECT a.n_name, a.n_nationkey AS k FROM nation a", None),
    "filter_cmp": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000.5 OR o_totalprice < 1200 AND o_orderstatus != 'O'", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_type LIKE '_____ %'", None),
    "filter_between": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", None),
    "filter_not_between": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_linenumber, 2) NOT BETWEEN 1 AND 5",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(NULLIF(l_linenumber, 2) BETWEEN 1 AND 5, false)",
    ),
    "filter_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')", None),
    "filter_not_in_list": (
        "SELECT p_partkey FROM part WHERE NULLIF(p_size, 11) NOT IN (1, 2, 3, 4, 5)",
        "SELECT p_partkey FROM part WHERE NOT coalesce(NULLIF(p_size, 11) IN (1, 2, 3, 4, 5), false)",
    ),
    "filter_in_null": ("SELECT p_partkey FROM part WHERE NULLIF(p_size, 11) IN (NULL, 7)", "SELECT p_partkey FROM part WHERE p_size = 11 OR p_size = 7"),
    "filter_not": ("SELECT p_partkey FROM part WHERE NOT NULLIF(p_size, 11) = 5", "SELECT p_partkey FROM part WHERE NOT (NULLIF(p_size, 11) IS NOT DISTINCT FROM 5)"),
    "filter_isnull": ("SELECT p_partkey FROM part WHERE NULLIF(p_size, 11) IS NULL", None),
    "filter_isnotnull": ("SELECT p_partkey FROM part WHERE NULLIF(p_size, 11) IS NOT NULL AND p_size > 40", None),
    "filter_null_equal": ("SELECT p_partkey FROM part WHERE NULLIF(p_size, 11) = NULLIF(p_size, 11)", "SELECT p_partkey FROM part"),
    "filter_parens": ("SELECT p_partkey FROM part WHERE (p_size + 1) * 2 > 60 AND (p_size = 30 OR NOT (p_size < 45))", None),
    "filter_cross_kind": ("SELECT p_partkey FROM part WHERE p_name = 1 OR p_size < 3", "SELECT p_partkey FROM part WHERE p_size < 3"),
    "semi_in": (
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
        None,
    ),
    "anti_not_in": (
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders)",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE NULLIF(o_custkey, 1) IS NOT DISTINCT FROM c_custkey)",
    ),
    "in_query_under_or": (
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) OR c_nationkey = 3",
        None,
    ),
    "exists_uncorrelated": ("SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_regionkey = 2)", None),
    "not_exists_uncorrelated": ("SELECT r_name FROM region WHERE NOT EXISTS (SELECT n_name FROM nation WHERE n_regionkey = 99)", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'P')", None),
    "scalar_in_select": ("SELECT r_name, r_regionkey + (SELECT COUNT(*) AS n FROM nation) AS x FROM region", None),
    "join_inner": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_left": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000",
        None,
    ),
    "join_right": ("SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000", None),
    "join_full": ("SELECT n.n_name, r.r_name FROM nation n FULL OUTER JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20", None),
    "join_null_keys": (
        "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 1) = NULLIF(b.n_regionkey, 1)",
        "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 1) IS NOT DISTINCT FROM NULLIF(b.n_regionkey, 1)",
    ),
    "join_theta": ("SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey AND n.n_nationkey > 5", None),
    "join_multi": (
        "SELECT n.n_name AS nation, COUNT(*) AS n, SUM(l.l_quantity) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
        " JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F' GROUP BY n.n_name",
        None,
    ),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "agg_global": (
        "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi, AVG(l_quantity) AS a FROM lineitem",
        "SELECT COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS s, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi, AVG(l_quantity) AS a FROM lineitem",
    ),
    "agg_group": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_quantity) AS a, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi"
        " FROM lineitem GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 200000 AND COUNT(*) * 2 > 30", None),
    "agg_null_group": ("SELECT NULLIF(p_size, 11) AS k, COUNT(*) AS n FROM part GROUP BY NULLIF(p_size, 11)", None),
    "agg_count_null": ("SELECT p_brand, COUNT(NULLIF(p_size, 11)) AS n FROM part GROUP BY p_brand", None),
    "agg_bare_column": ("SELECT n_nationkey, n_name, COUNT(*) AS n FROM nation GROUP BY n_nationkey", "SELECT n_nationkey, any_value(n_name) AS n_name, COUNT(*) AS n FROM nation GROUP BY n_nationkey"),
    "agg_sum_empty": (
        "SELECT SUM(p_size) AS s, AVG(p_size) AS a, MIN(p_name) AS lo, COUNT(p_size) AS n FROM part WHERE 1 = 2",
        "SELECT coalesce(SUM(p_size), 0)::BIGINT AS s, AVG(p_size) AS a, MIN(p_name) AS lo, COUNT(p_size) AS n FROM part WHERE 1 = 2",
    ),
    "agg_expression": ("SELECT p_brand, 2 * COUNT(*) + 1 AS n, MAX(p_size) - MIN(p_size) AS w FROM part GROUP BY p_brand", None),
    "agg_distinct_argument": (
        "SELECT l_returnflag, AVG(DISTINCT l_linenumber) AS a, SUM(DISTINCT l_linenumber) AS s, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, AVG(DISTINCT l_linenumber) AS a, SUM(DISTINCT l_linenumber)::BIGINT AS s, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    ),
    "having_without_group": ("SELECT COUNT(*) AS n, MAX(p_size) AS m FROM part HAVING COUNT(*) > 1", "SELECT COUNT(*) AS n, MAX(p_size) AS m FROM part HAVING COUNT(*) > 1"),
    "default_headers": (
        "SELECT p_brand, COUNT(*), MAX(p_size), UPPER(p_brand) FROM part GROUP BY p_brand",
        'SELECT p_brand, COUNT(*) AS "COUNT(*)", MAX(p_size) AS "MAX(p_size)", upper(p_brand) AS "upper(p_brand)" FROM part GROUP BY p_brand',
    ),
    "distinct_order_unselected": ("SELECT DISTINCT p_brand FROM part ORDER BY p_partkey LIMIT 5", "SELECT p_brand FROM part GROUP BY p_brand ORDER BY min(p_partkey) LIMIT 5"),
    "distinct_of_aggregates": ("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey", None),
    "join_cte_right": (
        "WITH per AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_custkey, p.n FROM customer c LEFT JOIN per p ON p.o_custkey = c.c_custkey",
        None,
    ),
    "expr_overflow": ("SELECT r_regionkey, r_regionkey + 9223372036854775807 AS x FROM region WHERE r_regionkey = 0", "SELECT r_regionkey, r_regionkey::BIGINT + 9223372036854775807 AS x FROM region WHERE r_regionkey = 0"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "order_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "order_nulls": (
        "SELECT NULLIF(p_size, 11) AS s, p_partkey FROM part ORDER BY s, p_partkey LIMIT 50",
        "SELECT NULLIF(p_size, 11) AS s, p_partkey FROM part ORDER BY s ASC NULLS FIRST, p_partkey LIMIT 50",
    ),
    "order_aggregate": (
        "SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey ORDER BY s DESC, o_custkey LIMIT 10",
        None,
    ),
    "distinct_order_limit": ("SELECT DISTINCT p_brand FROM part ORDER BY p_brand DESC LIMIT 7", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "union_chain": (
        "SELECT r_regionkey AS k FROM region UNION ALL SELECT r_regionkey FROM region UNION SELECT n_regionkey FROM nation",
        "SELECT r_regionkey AS k FROM region UNION ALL (SELECT r_regionkey FROM region UNION SELECT n_regionkey FROM nation)",
    ),
    "union_branch_limit": (
        "SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 3 UNION ALL SELECT r_regionkey FROM region",
        "(SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 3) UNION ALL SELECT r_regionkey FROM region",
    ),
    "cte_chain": (
        "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey)"
        " SELECT c.c_name, p.n FROM per p JOIN customer c ON c.c_custkey = p.o_custkey WHERE p.n > 1",
        None,
    ),
    "derived_table": ("SELECT t.seg, t.n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS t WHERE t.n > 5", None),
    "expr_arith": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS x, l_linenumber * 2 - 1 AS y FROM lineitem WHERE l_quantity < 3", None),
    "expr_int_div": (
        "SELECT o_orderkey, o_orderkey / o_custkey AS d, o_orderkey / (o_custkey - o_custkey) AS z FROM orders",
        "SELECT o_orderkey, o_orderkey // nullif(o_custkey, 0) AS d, CAST(NULL AS BIGINT) AS z FROM orders",
    ),
    "expr_float_div": ("SELECT p_partkey, p_retailprice / (p_size - 11) AS d FROM part", "SELECT p_partkey, p_retailprice / nullif(p_size - 11, 0) AS d FROM part"),
    "expr_case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c, CASE WHEN p_size = 5 THEN 1 END AS d FROM part", None),
    "expr_coalesce": ("SELECT p_partkey, COALESCE(NULLIF(p_size, 11), NULLIF(p_size, 12), 0) AS c, NULLIF(p_brand, 'Brand#11') AS b FROM part", None),
    "fn_string": (
        "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n FROM customer",
        "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, strlen(c_name)::BIGINT AS n FROM customer",
    ),
    "fn_text": (
        "SELECT doc_id, LENGTH(text) AS n, LENGTH(TRIM(text)) AS t FROM documents",
        "SELECT doc_id, strlen(text)::BIGINT AS n, strlen(trim(text, E' \\t\\n\\r'))::BIGINT AS t FROM documents",
    ),
    "ts_filter": (
        "SELECT COUNT(*) AS n, MIN(o_orderdate) AS lo FROM orders WHERE o_orderdate >= '1995-01-01 00:00:00' AND o_orderdate < '1997-01-01'",
        "SELECT COUNT(*) AS n, MIN(o_orderdate) AS lo FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'",
    ),
}


def _engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    return Engine(spark).register_parquet(sf_dir, *[t for t in TABLES if t in text])


def _select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir, text).select(text)


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).register_parquet(sf_dir, "nation", "region")
    e.script("CREATE VIEW europe AS SELECT n.n_name AS name, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey; CREATE VIEW few AS SELECT name FROM europe WHERE region = 'EUROPE'")
    return e.select("SELECT name FROM few")


_SUPPLIERS = "CREATE TABLE s (id INT PRIMARY KEY, name VARCHAR(30) NOT NULL, nation INT, bal DOUBLE); INSERT INTO s SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def _managed(changes: str, ask: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark).register_parquet(sf_dir, "supplier")
        e.script(_SUPPLIERS)
        e.script(changes)
        return e.select(ask)

    return run


MANAGED: dict[str, tuple[str, str, str]] = {
    "dml_insert_select": ("INSERT INTO s VALUES (1000001, 'new', NULL, -1.5)", "SELECT * FROM s", "SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nation, s_acctbal AS bal FROM supplier UNION ALL SELECT 1000001, 'new', NULL, -1.5"),
    "dml_update": ("UPDATE s SET bal = 0.5, name = 'poor' WHERE bal < 0 OR nation = 3", "SELECT id, name, bal FROM s", "SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 OR s_nationkey = 3 THEN 'poor' ELSE s_name END AS name, CASE WHEN s_acctbal < 0 OR s_nationkey = 3 THEN 0.5 ELSE s_acctbal END AS bal FROM supplier"),
    "dml_delete": ("DELETE FROM s WHERE nation NOT IN (1, 2, 3, 4, 5) AND bal > 1000", "SELECT id, nation FROM s", "SELECT s_suppkey AS id, s_nationkey::BIGINT AS nation FROM supplier WHERE NOT (s_nationkey NOT IN (1, 2, 3, 4, 5) AND s_acctbal > 1000)"),
    "ddl_alter": (
        "ALTER TABLE s ADD COLUMN note VARCHAR; ALTER TABLE s DROP COLUMN nation; ALTER TABLE s RENAME COLUMN bal TO balance; ALTER TABLE s RENAME TO t; CREATE INDEX i ON t (name); UPDATE t SET note = 'x' WHERE id = 5",
        "SELECT * FROM t", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CASE WHEN s_suppkey = 5 THEN 'x' END AS note FROM supplier",
    ),
}

# -- constraints, names and the API: scripts whose refused statements leave a state to select

_INSERT = "INSERT INTO {t} SELECT s_suppkey, s_name, s_nationkey FROM supplier"


def _refused(e: Engine, *statements: tuple[str, type[Exception]]) -> None:
    """Runs statements, each of which must fail by its error."""
    for text, error in statements:
        try:
            e.script(text)
        except error:
            continue
        raise AssertionError(f"{text} should be refused")


def _state(create: str, fill: str, refused: tuple[tuple[str, type[Exception]], ...], more: str, ask: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark).register_parquet(sf_dir, "supplier", "nation", "region")
        e.script(create)
        e.script(fill)
        _refused(e, *refused)
        if more:
            e.script(more)
        return e.select(ask)

    return run


_ALL = "SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nation FROM supplier"
_TABLE = "CREATE TABLE t (id INT{key}, name VARCHAR(30){name}, nation INT{nation})"


def _t(key: str = "", name: str = "", nation: str = "") -> str:
    return _TABLE.format(key=key, name=name, nation=nation)


_NATIONS = "CREATE TABLE n (k INT PRIMARY KEY, label VARCHAR); INSERT INTO n SELECT n_nationkey, n_name FROM nation; "
_FILL = _INSERT.format(t="t")

#: name: (tables, rows, what is refused and why, what goes on, the question, DuckDB's SQL for the answer)
STATES: dict[str, tuple[str, str, tuple[tuple[str, type[Exception]], ...], str, str, str]] = {
    "constraint_arity": (_t(), _FILL, (("INSERT INTO t VALUES (1, 'x')", ColumnCountMismatch), ("INSERT INTO t SELECT id, name FROM t", ColumnCountMismatch)), "", "SELECT * FROM t", _ALL),
    "constraint_types": (_t(), _FILL, (("INSERT INTO t VALUES ('one', 'x', 1)", TypeMismatch), ("UPDATE t SET nation = 'x'", TypeMismatch), ("INSERT INTO t SELECT name, name, id FROM t", TypeMismatch)), "", "SELECT * FROM t", _ALL),
    "constraint_auto_increment": (
        _t(key=" PRIMARY KEY AUTO_INCREMENT"), "INSERT INTO t SELECT NULLIF(1, 1), s_name, s_nationkey FROM supplier ORDER BY s_suppkey", (("INSERT INTO t VALUES (1, 'again', 0)", DuplicateKey),),
        "INSERT INTO t VALUES (NULL, 'next', 7)", "SELECT * FROM t",
        "SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_name AS name, s_nationkey::BIGINT AS nation FROM supplier UNION ALL SELECT count(*) + 1, 'next', 7 FROM supplier",
    ),
    "constraint_not_null": (_t(name=" NOT NULL"), _FILL, (("INSERT INTO t VALUES (0, NULL, 1)", NullConstraint), ("UPDATE t SET name = NULL WHERE id = 1", NullConstraint), ("INSERT INTO t SELECT id, NULLIF(name, name), nation FROM t", NullConstraint)), "", "SELECT * FROM t", _ALL),
    "constraint_primary_key": (_t(key=" PRIMARY KEY"), _FILL, ((_FILL, DuplicateKey), ("INSERT INTO t VALUES (NULL, 'x', 1)", NullConstraint), ("UPDATE t SET id = 5", DuplicateKey)), "INSERT INTO t VALUES (-1, 'new', NULL)", "SELECT * FROM t", _ALL + " UNION ALL SELECT -1, 'new', NULL"),
    "constraint_unique": (_t(name=" UNIQUE"), _FILL, (("INSERT INTO t SELECT id + 1000000, name, nation FROM t", DuplicateKey),), "INSERT INTO t VALUES (-1, NULL, 1), (-2, NULL, 1)", "SELECT * FROM t", _ALL + " UNION ALL SELECT -1, NULL, 1 UNION ALL SELECT -2, NULL, 1"),
    "unique_index": (
        _t(), _FILL + "; INSERT INTO t VALUES (-1, 'twice', 0), (-2, 'twice', 0); CREATE UNIQUE INDEX u ON t (id)",
        (("INSERT INTO t VALUES (1, 'again', 0)", DuplicateKey), ("CREATE UNIQUE INDEX v ON t (name)", DuplicateKey), ("CREATE INDEX u ON t (name)", IndexAlreadyExists)),
        "DROP INDEX u; INSERT INTO t VALUES (1, 'again', 0); CREATE INDEX u ON t (nation)", "SELECT * FROM t", _ALL + " UNION ALL SELECT -1, 'twice', 0 UNION ALL SELECT -2, 'twice', 0 UNION ALL SELECT 1, 'again', 0",
    ),
    "foreign_keys": (
        _NATIONS + _t(nation=" REFERENCES n(k)"), _FILL,
        (("INSERT INTO t VALUES (0, 'x', 99)", ForeignKeyViolation), ("UPDATE t SET nation = 99", ForeignKeyViolation), ("DELETE FROM n WHERE k IN (SELECT nation FROM t)", ForeignKeyViolation), ("ALTER TABLE n DROP COLUMN k", ForeignKeyViolation)),
        "INSERT INTO t VALUES (0, 'x', NULL); DELETE FROM t WHERE nation = 3; DELETE FROM n WHERE k = 3", "SELECT t.id, t.nation, n.label FROM t LEFT JOIN n ON t.nation = n.k",
        "SELECT s_suppkey AS id, s_nationkey::BIGINT AS nation, n_name AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey <> 3 UNION ALL SELECT 0, NULL, NULL",
    ),
    "index_upkeep": (
        _t(), _FILL + "; CREATE INDEX i ON t (nation)", (), "UPDATE t SET nation = 77 WHERE nation = 3; DELETE FROM t WHERE nation = 4; INSERT INTO t VALUES (0, 'x', 77); ALTER TABLE t RENAME COLUMN nation TO land; ALTER TABLE t RENAME TO u; DROP INDEX i; CREATE INDEX i ON u (land)",
        "SELECT id, land FROM u WHERE land = 77", "SELECT s_suppkey AS id, 77::BIGINT AS land FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 0, 77",
    ),
    "drop_table": (_t(), _FILL, (("CREATE TABLE t (a INT)", TableAlreadyExists),), "DROP TABLE t; DROP TABLE IF EXISTS t; CREATE TABLE t (only VARCHAR); INSERT INTO t SELECT r_name FROM region", "SELECT * FROM t", "SELECT r_name AS only FROM region"),
    "drop_view": (_t(), _FILL + "; CREATE VIEW v AS SELECT id FROM t", (("CREATE VIEW v AS SELECT name FROM t", TableAlreadyExists),), "DROP VIEW v; DROP VIEW IF EXISTS v; CREATE VIEW v AS SELECT name FROM t WHERE nation = 1", "SELECT v.name, r.r_name FROM region r JOIN v ON r.r_regionkey = 1", "SELECT s_name AS name, r_name FROM supplier, region WHERE s_nationkey = 1 AND r_regionkey = 1"),
    "names_resolve": (
        _t(), _FILL + "; CREATE TABLE w (id INT); INSERT INTO w VALUES (1); CREATE VIEW w AS SELECT id FROM t WHERE nation = 2", (),
        "", "WITH t AS (SELECT r_regionkey AS id FROM region) SELECT 'cte' AS place, id FROM t UNION ALL SELECT 'view', id FROM w",
        "SELECT 'cte' AS place, r_regionkey AS id FROM region UNION ALL SELECT 'view', s_suppkey FROM supplier WHERE s_nationkey = 2",
    ),
    "scalar_first_row": (_t(), "INSERT INTO t SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_suppkey DESC", (), "", "SELECT r_name, (SELECT id FROM t) AS first FROM region", "SELECT r_name, (SELECT max(s_suppkey) FROM supplier) AS first FROM region"),
}


def _row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).register_parquet(sf_dir, "supplier")
    e.script(_t() + "; INSERT INTO t SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_suppkey; INSERT INTO t VALUES (-5, 'last', NULL)")
    return spark.createDataFrame(e.catalog.read_rows_by_numbers("t", [0, 3, 7, 10]), "id long, name string, nation long")


def _index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).register_parquet(sf_dir, "supplier")
    e.script(_t() + "; " + _FILL + "; CREATE INDEX i ON t (nation)")
    return e.catalog.lookup_index("i", 7)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).register_parquet(sf_dir, "region")
    e.script("CREATE TABLE zeta (a INT PRIMARY KEY, b VARCHAR(9) NOT NULL); CREATE TABLE alpha (c INT REFERENCES zeta(a)); CREATE INDEX i ON zeta (b)")
    c = e.catalog
    rows = [("table", t, ", ".join(x.name for x in c.load_schema(t))) for t in c.list_tables()] + [("index", i, x["table"]) for i, x in c.load_index_meta().items()]
    rows += [("name", t, None) for t in e.tables()]
    return spark.createDataFrame(rows, "kind string, name string, detail string")


def _console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console says, dot commands included, line by line."""
    said: list[str] = []
    lines = ["CREATE TABLE t (id INT PRIMARY KEY, x DOUBLE, ok BOOLEAN)", "INSERT INTO t VALUES (1, 0.5, TRUE), (2, NULL, FALSE)", ".tables", ".schema t", "SELECT id, x, ok FROM t ORDER BY id", "SELECT * FROM nope", ".quit", "SELECT 1"]
    repl(Engine(spark), lines, said.append)
    rows = [(i, line) for i, line in enumerate("\n".join(said).split("\n"))]
    return spark.createDataFrame(rows, "line long, said string")


def _row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, written as tagged row text and imported."""
    e = Engine(spark)
    folder = Path(scratch_root(spark))
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "land.schema").write_text("land\nid:INT:PRIMARY_KEY\nlabel:VARCHAR(30):NOT_NULL\nsize:DOUBLE\n")
    regions = [r["r_name"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]  # five rows
    (folder / "land.data").write_text("".join(f"INT:{i}|STRING:{name}\\|{i}|{'NULL' if i == 2 else f'FLOAT:{i}.5'}\n" for i, name in enumerate(regions)))
    import_folder(e.catalog, str(folder))
    return e.select("SELECT * FROM land")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SELECT over orders as a stream, all that is there, into Parquet."""
    folder = scratch_root(spark)
    static = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    out = stream_select(Engine(spark), "o", stream, "SELECT o_orderkey, o_totalprice * 2 AS twice FROM o WHERE o_orderstatus = 'F' AND NOT o_totalprice < 100000")
    write_stream(out, f"{folder}/out", f"{folder}/seen", once=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "row_numbers": (_row_numbers, "SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nation FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier) WHERE n IN (0, 3, 7, 10) UNION ALL SELECT -5, 'last', NULL FROM (SELECT count(*) AS n FROM supplier) WHERE n IN (0, 3, 7, 10)"),
    "index_lookup": (_index_lookup, _ALL + " WHERE s_nationkey = 7"),
    "listing": (_listing, "SELECT * FROM (VALUES ('table', 'alpha', 'c'), ('table', 'zeta', 'a, b'), ('index', 'i', 'zeta'), ('name', 'alpha', NULL), ('name', 'region', NULL), ('name', 'zeta', NULL)) v(kind, name, detail)"),
    "console": (_console, "SELECT row_number() OVER () - 1 AS line, said FROM (SELECT unnest(['table t created', '2 rows inserted', 't', 'id INT PRIMARY KEY', 'x DOUBLE', 'ok BOOLEAN', 'id | x    | ok', '---+------+------', '1  | 0.5  | TRUE', '2  | NULL | FALSE', '(2 rows)', 'TableNotFound: nope']) AS said)"),
    "row_text_import": (_row_text, "SELECT r_regionkey AS id, r_name || '|' || r_regionkey AS label, CASE WHEN r_regionkey <> 2 THEN r_regionkey + 0.5::DOUBLE END AS size FROM region"),
    "stream_select": (_streamed, "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice < 100000"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _select(text) for name, (text, _) in SELECTS.items()}
QUERIES |= {"view": _view} | {name: _managed(changes, ask) for name, (changes, ask, _) in MANAGED.items()}
ORACLES: dict[str, str] = {name: duck or text for name, (text, duck) in SELECTS.items()}
ORACLES |= {"view": "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"} | {name: duck for name, (_, _, duck) in MANAGED.items()}
QUERIES |= {name: _state(*parts) for name, (*parts, _) in STATES.items()} | {name: run for name, (run, _) in API.items()}
ORACLES |= {name: duck for name, (*_, duck) in STATES.items()} | {name: duck for name, (_, duck) in API.items()}

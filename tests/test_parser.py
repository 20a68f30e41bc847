import pytest

from millrace.errors import ParseError
from millrace.plans import nodes as N
from millrace.plans import parse_script, parse_sql

GOOD = """SELECT * FROM users
select id, name from users where id = 1
SELECT users.id AS i FROM users
SELECT u.id FROM users u JOIN orders o ON u.id = o.user_id
SELECT u.id FROM users u INNER JOIN orders o ON u.id = o.user_id WHERE o.quantity > 2
SELECT * FROM a LEFT JOIN b ON a.x = b.x RIGHT JOIN c ON b.y = c.y
SELECT * FROM a FULL JOIN b ON a.x = b.x
SELECT * FROM a FULL OUTER JOIN b ON a.x < b.x
SELECT * FROM a LEFT OUTER JOIN b ON a.x = b.x
SELECT COUNT(*) FROM users
SELECT COUNT(*), SUM(u.x), AVG(x), MIN(x), MAX(x) FROM u
SELECT dept, COUNT(*) AS n FROM emp GROUP BY dept HAVING COUNT(*) > 5 AND SUM(salary) > 10.5
SELECT a FROM t ORDER BY a DESC, b ASC, c LIMIT 10
SELECT DISTINCT a, b FROM t
SELECT a FROM t WHERE a IN (1, 2, NULL) AND b NOT IN ('x') OR NOT c = 2
SELECT a FROM t WHERE a IN (SELECT b FROM u)
SELECT a FROM t WHERE a NOT IN (SELECT b FROM u WHERE c = TRUE)
SELECT a FROM t WHERE EXISTS (SELECT b FROM u) AND NOT EXISTS (SELECT c FROM v)
SELECT a FROM t WHERE a IS NULL OR b IS NOT NULL
SELECT a FROM t WHERE a BETWEEN 1 AND 2 AND b NOT BETWEEN -1 AND 3
SELECT a FROM t WHERE a > (SELECT AVG(b) FROM u)
SELECT a FROM t WHERE (SELECT MAX(b) FROM u) = a
SELECT a FROM t WHERE (a + b) * 2 > 3
SELECT a FROM t WHERE name LIKE 'a%_' AND name NOT LIKE 'b%'
SELECT a + b * 2 - c / 4 AS x FROM t
SELECT UPPER(name), LOWER(TRIM(name)), LENGTH(name) AS n FROM t
SELECT COALESCE(a, b, 'none'), NULLIF(a, 0) FROM t
SELECT CASE WHEN a > 1 THEN 'x' WHEN b IS NULL THEN 'y' ELSE 'z' END AS c FROM t
SELECT a FROM (SELECT b AS a FROM u WHERE b > 1) AS s WHERE a < 5
WITH c AS (SELECT a FROM t), d AS (SELECT a FROM c) SELECT * FROM d
SELECT a FROM t UNION SELECT b FROM u
SELECT a FROM t UNION ALL SELECT b FROM u UNION SELECT c FROM v
SELECT a FROM t WHERE a <> 1;
SELECT nullable, trueish, falsey FROM t
SELECT a FROM t -- and a remark
SELECT t.* FROM t
INSERT INTO t VALUES (1, 'x', NULL, TRUE, -2.5)
INSERT INTO t VALUES ('it''s', '')
INSERT INTO t SELECT a, b FROM u WHERE a > 1
UPDATE t SET a = 1, b = 'x' WHERE c = 2 OR d IS NULL
UPDATE t SET a = NULL
DELETE FROM t WHERE a != 1
DELETE FROM t
CREATE TABLE t (id INT NOT NULL UNIQUE AUTO_INCREMENT PRIMARY KEY, n VARCHAR(255), f FLOAT, d DOUBLE, b BOOLEAN, c BOOL, e DATE, g TIMESTAMP, r INT REFERENCES u(id))
CREATE VIEW v AS SELECT a FROM t WHERE a > 1
CREATE INDEX i ON t (a)
CREATE UNIQUE INDEX i ON t (a)
DROP TABLE t
DROP TABLE IF EXISTS t
DROP VIEW IF EXISTS v
DROP INDEX i
ALTER TABLE t ADD COLUMN x INT
ALTER TABLE t ADD x VARCHAR(10) UNIQUE
ALTER TABLE t DROP COLUMN x
ALTER TABLE t DROP x
ALTER TABLE t RENAME COLUMN a TO b
ALTER TABLE t RENAME TO u""".splitlines()

BAD = """SELECT
SELECT FROM t
SELECT a
SELECT a FROM
SELECT a FROM t WHERE
SELECT a FROM t LIMIT -1
SELECT a FROM t LIMIT 1.5
SELECT a FROM t extra words
SELECT a FROM t GROUP a
SELECT a FROM t JOIN u
SELECT a FROM (SELECT b FROM u)
SELECT FOO(a) FROM t
SELECT UPPER(a, b) FROM t
SELECT CASE ELSE 1 END FROM t
SELECT a FROM t WHERE a IN ()
SELECT a FROM t WHERE a NOT 1
SELECT a FROM t WHERE a = 'open
INSERT INTO t VALUES ()
INSERT INTO t VALUES (1,)
INSERT INTO t VALUES (a)
INSERT INTO t VALUES (99999999999999999999)
UPDATE t a = 1
DELETE t
CREATE TABLE t ()
CREATE TABLE t (a TEXT)
CREATE TABLE t (a BIGINT)
CREATE UNIQUE TABLE t (a INT)
DROP t
ALTER TABLE t MOVE a
nonsense
""".splitlines()


@pytest.mark.parametrize("sql", GOOD)
def test_accepts(sql):
    assert parse_sql(sql) is not None


@pytest.mark.parametrize("sql", BAD)
def test_refuses(sql):
    with pytest.raises(ParseError):
        parse_sql(sql)


def test_precedence():
    p = parse_sql("SELECT a FROM t WHERE NOT a = 1 AND b = 2 OR c = 3").where
    assert isinstance(p, N.Logic) and p.op == "OR" and p.left.op == "AND" and isinstance(p.left.left, N.Not)
    e = parse_sql("SELECT a - b - c * 2 AS x FROM t").items[0].expr
    assert e == N.Arith("-", N.Arith("-", N.Col(None, "a"), N.Col(None, "b")), N.Arith("*", N.Col(None, "c"), N.Lit(2)))


def test_union_is_right_associative():
    q = parse_sql("SELECT a FROM t UNION ALL SELECT b FROM u UNION SELECT c FROM v")
    every, rest = q.union
    assert every and rest.union[0] is False


def test_script_and_view_text():
    made = parse_script("CREATE VIEW v AS SELECT a FROM t WHERE a = 'x;y'; /* z */ DROP VIEW v;;")
    assert made == [N.CreateView("v", "SELECT a FROM t WHERE a = 'x;y'"), N.Drop("VIEW", "v")]


def test_very_deep_nesting_is_an_error():
    with pytest.raises(ParseError):
        parse_sql("SELECT a FROM t WHERE " + "(" * 5000 + "a = 1" + ")" * 5000)

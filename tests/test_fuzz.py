"""Random statements end in a result or in the engine's own error."""

import random

from millrace.engine import Engine
from millrace.errors import EngineError
from millrace.plans import parse_sql

WORDS = "SELECT FROM WHERE AND OR NOT IN IS NULL BETWEEN LIKE GROUP BY HAVING ORDER LIMIT UNION ALL JOIN LEFT ON AS COUNT SUM ( ) , * = != < > <= >= <> + - / . ; 'x' '%' 1 2.5 t1 t2 id name val EXISTS CASE WHEN THEN END COALESCE NULLIF UPPER INSERT INTO VALUES UPDATE SET DELETE".split()


def test_parser_never_fails_otherwise():
    rng = random.Random(12345)
    for _ in range(3000):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 25)))
        if rng.random() < 0.2:
            text = "".join(chr(rng.randrange(1, 500)) for _ in range(30))
        try:
            parse_sql(text)
        except EngineError:
            pass


def _condition(rng, depth=0):
    x = lambda: rng.choice(["id", "name", "val", "1", "'a'", "NULL", "id + 1", "UPPER(name)", "val / id", "TRUE"])
    made = rng.choice(["{} = {}", "{} != {}", "{} < {}", "{} LIKE {}", "{} IS NULL", "{} IN (1, 'a', NULL)", "{} NOT IN (2)", "{} BETWEEN {} AND {}", "{} NOT BETWEEN {} AND {}", "{} IN (SELECT id FROM t2)", "EXISTS (SELECT id FROM t2)"])
    made = made.format(*[x() for _ in range(made.count("{}"))])
    if depth < 2 and rng.random() < 0.6:
        made = f"({made} {rng.choice(['AND', 'OR'])} {rng.choice(['', 'NOT '])}{_condition(rng, depth + 1)})"
    return made


def test_selects_plan_or_raise(spark):
    e = Engine(spark)
    e.register("t1", spark.createDataFrame([(1, "alice", 1.5), (2, "bob", None)], "id long, name string, val double"))
    e.register("t2", spark.createDataFrame([(1, 100)], "id long, n long"))
    rng = random.Random(67890)
    for i in range(60):
        items = rng.choice(["*", "id", "name, COUNT(*)", "id + val AS v", "DISTINCT name", "CASE WHEN id = 1 THEN name END AS c"])
        sql = f"SELECT {items} FROM t1 WHERE {_condition(rng)}" + rng.choice(["", " ORDER BY id DESC", " GROUP BY name", " LIMIT 1"])
        try:
            df = e.sql(sql).df
        except EngineError:
            continue
        if i % 6 == 0:
            df.collect()

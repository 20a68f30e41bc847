"""Lowering of expressions to Spark columns.

Logic is two-valued: a comparison with null is false. Filters, joins and CASE treat null as false already, and AND and OR
are monotone, so a null may stand for false wherever no NOT is above it; only there is it made false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields, is_dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.functions.types import Typed, arithmetic, compare, literal, scalar_function, unify
from millrace.operators.relation import Relation, new_id
from millrace.plans import nodes as N


def certain(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


class Lowering:
    """Lowers expressions over one relation. IN (SELECT …) joins a marker to it, so ``rel`` may change."""

    def __init__(self, rel: Relation, query: Callable[[N.Select], Relation], ready: dict[N.Node, Typed] | None = None) -> None:
        self.rel, self.query, self.ready = rel, query, ready or {}

    def value(self, e: N.Node) -> Typed:
        if e in self.ready:
            return self.ready[e]
        match e:
            case N.Lit(value):
                return literal(value)
            case N.Col(table, name):
                return self.rel.typed(self.rel.find(table, name))
            case N.Arith(op, left, right):
                return arithmetic(op, self.value(left), self.value(right))
            case N.Func(name, args):
                return scalar_function(name, [self.value(a) for a in args])
            case N.Case(whens, other):
                cols, kind = unify([*(self.value(v) for _, v in whens), self.value(other) if other else literal(None)])
                out = None
                for (cond, _), col in zip(whens, cols):
                    p = self.predicate(cond)
                    out = F.when(p, col) if out is None else out.when(p, col)
                assert out is not None
                return Typed(out.otherwise(cols[-1]), kind)
            case N.Scalar(query):
                sub = self.query(query)
                first = sub.df.orderBy(*sub.order) if sub.order else sub.df  # the first row in order of insertion
                return Typed(first.select(sub.cols[0].id).limit(1).scalar(), sub.cols[0].kind)
            case N.Agg():
                raise EngineError(f"{e.name} is not allowed here")
            case _:
                return Typed(certain(self.predicate(e)), "bool")

    def predicate(self, e: N.Node) -> Column:
        """True, false, or null for false."""
        match e:
            case N.Logic(op, left, right):
                a, b = self.predicate(left), self.predicate(right)
                return a & b if op == "AND" else a | b
            case N.Not(inner):
                return ~certain(self.predicate(inner))
            case N.Compare(op, left, right):
                return compare(op, self.value(left), self.value(right))
            case N.IsNull(inner, negated):
                x = self.value(inner)
                if x.kind == "null":
                    return F.lit(not negated)
                return x.col.isNotNull() if negated else x.col.isNull()
            case N.Between(inner, low, high, negated):
                x = self.value(inner)
                p = compare(">=", x, self.value(low)) & compare("<=", x, self.value(high))
                return ~certain(p) if negated else p
            case N.InList(inner, values, negated):
                p = self.in_list(self.value(inner), [self.value(v) for v in values])
                return ~certain(p) if negated else p
            case N.InQuery(inner, query, negated):
                p = self.in_query(inner, query)
                return ~p if negated else p
            case N.Exists(query, negated):
                p = self.query(query).df.exists()
                return ~p if negated else p
            case _:
                x = self.value(e)
                return x.col if x.kind == "bool" else F.lit(False)

    @staticmethod
    def in_list(x: Typed, values: list[Typed]) -> Column:
        plain = [v for v in values if v.kind != "null"]
        if x.kind == "null":
            return F.lit(len(plain) < len(values))
        alike = lambda v: v.kind == x.kind or {v.kind, x.kind} == {"long", "double"}
        same = [v.value for v in plain if alike(v)]
        out = x.col.isin(*same) if same else F.lit(False)
        for v in plain:
            if not alike(v) and {x.kind, v.kind} & {"date", "ts"}:
                out = out | compare("=", x, v)
        return certain(out) | x.col.isNull() if len(plain) < len(values) else out

    def in_query(self, inner: N.Node, query: N.Select) -> Column:
        """A left join with the distinct values, null-safe, and a mark on those found."""
        sub = self.query(query)
        key, mark = new_id("key"), new_id("mark")
        found = sub.df.select(F.col(sub.cols[0].id).alias(key)).distinct().withColumn(mark, F.lit(True))
        x = self.value(inner)
        on = compare("=", x, Typed(F.col(key), sub.cols[0].kind))
        self.rel = replace(self.rel, df=self.rel.df.join(found, on, "left"))
        return F.col(mark).isNotNull()

    def semi(self, inner: N.Node, query: N.Select, anti: bool) -> None:
        """IN and NOT IN as a conjunct of a filter."""
        sub = self.query(query)
        key = new_id("key")
        found = sub.df.select(F.col(sub.cols[0].id).alias(key))
        on = compare("=", self.value(inner), Typed(F.col(key), sub.cols[0].kind))
        self.rel = replace(self.rel, df=self.rel.df.join(found, on, "left_anti" if anti else "left_semi"))

    def filter(self, e: N.Node) -> None:
        """Keeps the rows of ``rel`` for which e is true."""
        rest: list[N.Node] = []
        for c in conjuncts(e):
            if isinstance(c, N.Not) and isinstance(c.inner, N.InQuery):
                c = replace(c.inner, negated=not c.inner.negated)
            if isinstance(c, N.InQuery):
                self.semi(c.inner, c.query, c.negated)
            else:
                rest.append(c)
        for c in rest:
            p = self.predicate(c)
            self.rel = replace(self.rel, df=self.rel.df.where(p))


def conjuncts(e: N.Node) -> Iterator[N.Node]:
    if isinstance(e, N.Logic) and e.op == "AND":
        yield from conjuncts(e.left)
        yield from conjuncts(e.right)
    else:
        yield e


def walk(e: Any) -> Iterator[N.Node]:
    """An expression and those under it, aggregates' arguments and subqueries left out."""
    if isinstance(e, N.Select):
        return
    if isinstance(e, tuple):
        for x in e:
            yield from walk(x)
        return
    if isinstance(e, N.Node):
        yield e
        if not isinstance(e, N.Agg) and is_dataclass(e):
            for f in fields(e):
                yield from walk(getattr(e, f.name))


def header(e: N.Node) -> str:
    """What a column without an alias is called."""
    match e:
        case N.Col(_, name):
            return name
        case N.Agg(name, None):
            return f"{name}(*)"
        case N.Agg(name, arg):
            return f"{name}({_shown(arg)})"
        case _:
            return _shown(e)


def _shown(e: N.Node) -> str:
    match e:
        case N.Col(table, name):
            return f"{table}.{name}" if table else name
        case N.Lit(value):
            return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else f"'{value}'" if isinstance(value, str) else str(value)
        case N.Arith(op, left, right):
            return f"{_shown(left)} {op} {_shown(right)}"
        case N.Func(name, args):
            return f"{name.lower()}({', '.join(map(_shown, args))})"
        case N.Case():
            return "case"
        case N.Scalar():
            return "subquery"
        case N.Agg():
            return header(e)
        case _:
            return "condition"

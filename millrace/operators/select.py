"""Lowering of a SELECT: from, joins, where, group, having, projection, order, distinct, limit, union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace.errors import ColumnCountMismatch, ColumnNotFound, EngineError
from millrace.functions.types import Typed, aggregate, unify
from millrace.operators.expressions import Lowering, header, walk
from millrace.operators.relation import RelCol, Relation, new_id
from millrace.plans import nodes as N

#: Finds a table or view by name.
Source = Callable[[str], Relation]


class SelectLowering:
    def __init__(self, source: Source, ctes: dict[str, Relation] | None = None) -> None:
        self.source, self.ctes = source, dict(ctes or {})

    def query(self, q: N.Select) -> Relation:
        """A relation with the columns that q selects; sorted if q sorts."""
        inner = SelectLowering(self.source, self.ctes)
        for name, sub in q.ctes:
            inner.ctes[name] = inner.query(sub)
        left = inner.branch(q)
        if q.union is None:
            return left
        every, rest = q.union
        return union(left, inner.query(rest), every)

    # -- from and joins
    def scan(self, target: N.Table | N.Derived) -> Relation:
        if isinstance(target, N.Derived):
            got, name = self.query(target.query), target.alias
        else:
            got, name = self.ctes.get(target.name) or self.source(target.name), target.alias or target.name
        fresh = {c.id: new_id(c.name) for c in got.cols} | {o: new_id("rid") for o in got.order}  # a relation may be scanned twice
        df = got.df.select(*[F.col(a).alias(b) for a, b in fresh.items()])
        return Relation(df, tuple(RelCol(name, c.name, fresh[c.id], c.kind) for c in got.cols), tuple(fresh[o] for o in got.order))

    def join(self, left: Relation, j: N.Join) -> Relation:
        right = self.scan(j.target)
        both = Relation(left.df, left.cols + right.cols, left.order + right.order if left.order and right.order else ())
        if any(isinstance(e, N.InQuery) for e in walk(j.on)):
            return self._join_with_subquery(left, right, both, j)
        on = Lowering(both, self.query).predicate(j.on)
        return replace(both, df=left.df.join(right.df, on, j.kind))

    def _join_with_subquery(self, left: Relation, right: Relation, both: Relation, j: N.Join) -> Relation:
        """IN (SELECT …) in an ON: each is marked on the side its operand comes from, before the join."""
        sides = {"l": Lowering(left, self.query), "r": Lowering(right, self.query)}
        ready: dict[N.Node, Typed] = {}
        for e in walk(j.on):
            if isinstance(e, N.InQuery):
                ids = {both.find(c.table, c.name).id for c in walk(e.inner) if isinstance(c, N.Col)}
                side = "l" if ids <= {c.id for c in left.cols} else "r" if ids <= {c.id for c in right.cols} else None
                if side is None:
                    raise EngineError("the operand of IN (SELECT …) in ON must come from one side")
                found = sides[side].in_query(e.inner, e.query)
                ready[e] = Typed(~found if e.negated else found, "bool")
        low = Lowering(both, self.query, ready)
        plain = low.predicate
        low.predicate = lambda e: ready[e].col if e in ready else plain(e)  # type: ignore[method-assign]
        return replace(both, df=sides["l"].rel.df.join(sides["r"].rel.df, low.predicate(j.on), j.kind))

    # -- one SELECT without its UNION
    def branch(self, q: N.Select) -> Relation:
        rel = self.scan(q.source)
        for j in q.joins:
            rel = self.join(rel, j)
        if q.where is not None:
            low = Lowering(rel, self.query)
            low.filter(q.where)
            rel = low.rel
        parts = (*(i.expr for i in q.items), q.having, *(o.expr for o in q.order))
        if q.group or q.having is not None or any(isinstance(e, N.Agg) for p in parts if p is not None for e in walk(p)):
            return self.finish(q, self.grouped(q, rel), grouped=True)
        return self.finish(q, Lowering(rel, self.query))

    def grouped(self, q: N.Select, rel: Relation) -> Lowering:
        """Aggregates once, for everything the rest of q mentions; columns that are no keys come from a group's first row."""
        low = Lowering(rel, self.query)
        parts = [i.expr for i in q.items] + ([q.having] if q.having is not None else []) + [o.expr for o in q.order if not self.is_alias(q, o.expr)]
        keys: dict[str, tuple[str, str]] = {}  # id before -> id after, kind
        ready: dict[N.Node, Typed] = {}
        by: list[Column] = []
        for g in q.group:
            x, key = low.value(g), new_id("key")
            by.append(x.col.alias(key))
            if isinstance(g, N.Col):
                keys[rel.find(g.table, g.name).id] = (key, x.kind)
            else:
                ready[g] = Typed(F.col(key), x.kind)
        made: list[Column] = []
        firsts: dict[str, str] = {}
        for part in parts:
            for e in self.outside(part, ready):
                if isinstance(e, N.Agg) and e not in ready:
                    got, at = aggregate(e.name, low.value(e.arg) if e.arg is not None else None, e.distinct), new_id("agg")
                    made.append(got.col.alias(at))
                    ready[e] = Typed(F.col(at), got.kind)
                elif isinstance(e, N.Star):
                    raise EngineError("* doesn't go with aggregates")
                elif isinstance(e, N.Col):
                    c = rel.find(e.table, e.name)
                    if c.id not in keys and c.id not in firsts:
                        firsts[c.id] = new_id(c.name)
                        rank = F.struct(*rel.order) if rel.order else None
                        made.append((F.min_by(c.id, rank) if rank is not None else F.first(c.id)).alias(firsts[c.id]))
        order: tuple[str, ...] = ()
        if rel.order and q.group:
            order = (new_id("rid"),)
            made.append(F.min(F.struct(*rel.order)).alias(order[0]))
        df = low.rel.df.groupBy(*by).agg(*made) if by and made else low.rel.df.select(*by).distinct() if by else low.rel.df.agg(*(made or [F.count(F.lit(1)).alias(new_id())]))
        cols = tuple(RelCol(c.table, c.name, keys[c.id][0] if c.id in keys else firsts[c.id], c.kind) for c in rel.cols if c.id in keys or c.id in firsts)
        out = Lowering(Relation(df, cols, order), self.query, ready)
        if q.having is not None:
            out.filter(q.having)
        return out

    @staticmethod
    def outside(part: N.Node, ready: dict[N.Node, Typed]) -> list[N.Node]:
        """What an expression mentions, group expressions left out."""
        if part in ready:
            return []
        out = []
        skip: set[int] = set()
        for e in walk(part):
            if id(e) in skip:
                continue
            if e in ready:
                skip |= {id(x) for x in walk(e)}
            else:
                out.append(e)
        return out

    @staticmethod
    def is_alias(q: N.Select, e: N.Node) -> bool:
        return isinstance(e, N.Col) and e.table is None and any(i.alias == e.name for i in q.items)

    def finish(self, q: N.Select, low: Lowering, grouped: bool = False) -> Relation:
        """Projection, ORDER BY, DISTINCT, LIMIT."""
        picked: list[tuple[str, Typed]] = []
        for item in q.items:
            if isinstance(item.expr, N.Star):
                cols = [c for c in low.rel.cols if item.expr.table in (None, c.table)]
                if not cols:
                    raise ColumnNotFound(f"{item.expr.table}.*")
                picked += [(c.name, low.rel.typed(c)) for c in cols]
            else:
                picked.append((item.alias or header(item.expr), low.value(item.expr)))
        names = {name: i for i, (name, _) in reversed(list(enumerate(picked)))}
        out = tuple(RelCol(None, name, new_id(name), x.kind) for name, x in picked)
        sort: list[tuple[Typed, bool]] = []
        for o in q.order:
            by_name = isinstance(o.expr, N.Col) and o.expr.table is None and o.expr.name in names
            if grouped and by_name:
                sort.append((picked[names[o.expr.name]][1], o.desc))  # type: ignore[union-attr]
                continue
            try:
                sort.append((low.value(o.expr), o.desc))
            except ColumnNotFound:
                if not by_name:
                    raise
                sort.append((picked[names[o.expr.name]][1], o.desc))  # type: ignore[union-attr]
        rel = low.rel
        keys = [new_id("sort") for _ in sort]
        rows = rel.df.select(*[x.col.alias(c.id) for (_, x), c in zip(picked, out)], *[x.col.alias(k) for (x, _), k in zip(sort, keys)], *rel.order)
        order = rel.order
        ids = [c.id for c in out]
        down = [d for _, d in sort]
        if q.distinct:
            if keys:
                # a row's rank is that of its first appearance in the sorted rows
                w = Window.partitionBy(*ids).orderBy(*self.sorted_by(keys, down, order))
                one = new_id("rank")
                rows = rows.withColumn(one, F.row_number().over(w)).where(F.col(one) == 1).drop(one) if not self.covered(picked, sort) else rows.groupBy(*ids).agg(*[F.first(k).alias(k) for k in keys])
                order = order if not self.covered(picked, sort) else ()
            elif order:
                at = new_id("rid")
                rows, order = rows.groupBy(*ids).agg(F.min(F.struct(*order)).alias(at)), (at,)
            else:
                rows = rows.distinct()
        if keys:
            rows = rows.orderBy(*self.sorted_by(keys, down, order))
        elif q.limit is not None and order:
            rows = rows.orderBy(*order)
        if q.limit is not None:
            rows = rows.limit(q.limit)
        if keys:
            return Relation(rows.select(*ids), out)
        return Relation(rows, out, order)

    @staticmethod
    def covered(picked: list[tuple[str, Typed]], sort: list[tuple[Typed, bool]]) -> bool:
        """Every sort key is a column of the result, so equal rows sort alike."""
        return all(any(x is p for _, p in picked) or any(str(x.col) == str(p.col) for _, p in picked) for x, _ in sort)

    @staticmethod
    def sorted_by(keys: list[str], down: list[bool], order: tuple[str, ...]) -> list[Column]:
        """Nulls come first ascending and last descending; the order of insertion breaks ties."""
        return [F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in zip(keys, down)] + [F.col(o).asc() for o in order]


def union(left: Relation, right: Relation, every: bool) -> Relation:
    if len(left.cols) != len(right.cols):
        raise ColumnCountMismatch(f"{len(left.cols)} and {len(right.cols)} columns in a UNION")
    ids = [new_id(c.name) for c in left.cols]
    lefts, rights, kinds = [], [], []
    for a, b in zip(left.cols, right.cols):
        (x, y), kind = unify([left.typed(a), right.typed(b)])
        lefts.append(x)
        rights.append(y)
        kinds.append(kind)
    cols = tuple(RelCol(None, c.name, i, k) for c, i, k in zip(left.cols, ids, kinds))
    order: tuple[str, ...] = ()
    if left.order and right.order:
        # where both sides have an order, the left one's rows come first; a row has the other side's order as nulls
        side, firsts, seconds = new_id("side"), [new_id("rid") for _ in left.order], [new_id("rid") for _ in right.order]
        order = (side, *firsts, *seconds)
        none = lambda r, names, ids: [F.lit(None).cast(r.df.schema[n].dataType).alias(i) for n, i in zip(names, ids)]
        lefts_order = [F.lit(0).alias(side), *[F.col(o).alias(i) for o, i in zip(left.order, firsts)], *none(right, right.order, seconds)]
        rights_order = [F.lit(1).alias(side), *none(left, left.order, firsts), *[F.col(o).alias(i) for o, i in zip(right.order, seconds)]]
    else:
        lefts_order = rights_order = []
    df = left.df.select(*[x.alias(i) for x, i in zip(lefts, ids)], *lefts_order).union(right.df.select(*[y.alias(i) for y, i in zip(rights, ids)], *rights_order))
    if every:
        return Relation(df, cols, order)
    if not order:
        return Relation(df.distinct(), cols)
    at = new_id("rid")  # a row's place is that of its first appearance
    return Relation(df.groupBy(*ids).agg(F.min(F.struct(*order)).alias(at)), cols, (at,))

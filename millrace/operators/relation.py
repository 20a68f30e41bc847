"""A DataFrame whose columns have ids of their own, beside the names that SQL text uses for them."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import ColumnNotFound
from millrace.functions.types import Typed, kind_of

_ids = itertools.count()


def new_id(name: str = "") -> str:
    """Unique in the process, so self-joins and equal names never clash."""
    return f"m{next(_ids)}_{name}" if name.isidentifier() else f"m{next(_ids)}"


@dataclass(frozen=True)
class RelCol:
    table: str | None
    name: str
    id: str
    kind: str


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    cols: tuple[RelCol, ...]
    #: Columns that put rows in the order of insertion, where that is known; hidden from SELECT *.
    order: tuple[str, ...] = ()

    @staticmethod
    def of(df: DataFrame, name: str | None, hidden: str | None = None) -> Relation:
        cols = [RelCol(name, f.name, new_id(f.name), kind_of(f.dataType)) for f in df.schema.fields if f.name != hidden]
        plain = [f"p{i}" for i in range(len(df.columns))]
        by_place = df.toDF(*plain)  # names may repeat
        at = [i for i, f in enumerate(df.schema.fields) if f.name != hidden]
        picked = [F.col(plain[i]).alias(c.id) for i, c in zip(at, cols)]
        order: tuple[str, ...] = ()
        if hidden is not None:
            order = (new_id("rid"),)
            picked.append(F.col(plain[df.columns.index(hidden)]).alias(order[0]))
        return Relation(by_place.select(*picked), tuple(cols), order)

    def named(self, name: str) -> Relation:
        return replace(self, cols=tuple(replace(c, table=name) for c in self.cols))

    def find(self, table: str | None, name: str) -> RelCol:
        """The leftmost column of that name."""
        for c in self.cols:
            if c.name == name and table in (None, c.table):
                return c
        raise ColumnNotFound(f"{table}.{name}" if table else name)

    def typed(self, c: RelCol) -> Typed:
        return Typed(F.col(c.id), c.kind)

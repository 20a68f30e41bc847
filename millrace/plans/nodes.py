"""Syntax tree: statements, selects and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Node:
    """An expression."""


@dataclass(frozen=True)
class Lit(Node):
    value: Any  # None, bool, int, float or str


@dataclass(frozen=True)
class Col(Node):
    table: str | None
    name: str


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class Arith(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str  # = != > < >= <= LIKE
    left: Node
    right: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str  # AND OR
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    inner: Node


@dataclass(frozen=True)
class IsNull(Node):
    inner: Node
    negated: bool


@dataclass(frozen=True)
class Between(Node):
    inner: Node
    low: Node
    high: Node
    negated: bool


@dataclass(frozen=True)
class InList(Node):
    inner: Node
    values: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Node):
    inner: Node
    query: Select
    negated: bool


@dataclass(frozen=True)
class Exists(Node):
    query: Select
    negated: bool


@dataclass(frozen=True)
class Scalar(Node):
    query: Select


@dataclass(frozen=True)
class Case(Node):
    whens: tuple[tuple[Node, Node], ...]
    other: Node | None


@dataclass(frozen=True)
class Func(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Agg(Node):
    name: str
    arg: Node | None  # None: *
    distinct: bool = False


@dataclass(frozen=True)
class Item:
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: Select
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str  # inner left right full
    target: Table | Derived
    on: Node


@dataclass(frozen=True)
class Order:
    expr: Node
    desc: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Table | Derived
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False
    union: tuple[bool, Select] | None = None  # (all, right side)
    ctes: tuple[tuple[str, Select], ...] = ()
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # INT FLOAT DOUBLE BOOLEAN DATE TIMESTAMP VARCHAR
    length: int | None = None
    not_null: bool = False
    unique: bool = False
    auto_increment: bool = False
    primary_key: bool = False
    references: tuple[str, str] | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateView:
    name: str
    text: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool


@dataclass(frozen=True)
class Drop:
    kind: str  # TABLE VIEW INDEX
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnDef


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class RenameColumn:
    table: str
    old: str
    new: str


@dataclass(frozen=True)
class RenameTable:
    table: str
    new: str


@dataclass(frozen=True)
class InsertValues:
    table: str
    rows: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class InsertSelect:
    table: str
    query: Select


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Node], ...]
    where: Node | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Node | None

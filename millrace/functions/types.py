"""Kinds of values, how Spark types map to them, and how kinds meet in comparisons and branches."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import TypeMismatch

NUMBERS = ("long", "double")
#: SQL type -> (Spark type, kind)
SQL_TYPES: dict[str, tuple[T.DataType, str]] = {
    "INT": (T.LongType(), "long"), "FLOAT": (T.DoubleType(), "double"), "DOUBLE": (T.DoubleType(), "double"), "BOOLEAN": (T.BooleanType(), "bool"),
    "DATE": (T.DateType(), "date"), "TIMESTAMP": (T.TimestampNTZType(), "ts"), "VARCHAR": (T.StringType(), "str"),
}
_NOTHING = object()


@dataclass(frozen=True)
class Typed:
    """A column with its kind, and its value where it is a literal."""

    col: Column
    kind: str  # long double str bool date ts null other
    value: Any = _NOTHING

    @property
    def is_literal(self) -> bool:
        return self.value is not _NOTHING


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "long"
    if isinstance(t, T.FractionalType):
        return "double"
    return next((k for cls, k in ((T.StringType, "str"), (T.BooleanType, "bool"), (T.DateType, "date"), (T.TimestampNTZType, "ts"), (T.TimestampType, "ts"), (T.NullType, "null")) if isinstance(t, cls)), "other")


def literal(value: Any) -> Typed:
    kind = {type(None): "null", bool: "bool", int: "long", float: "double", str: "str"}[type(value)]
    return Typed(F.lit(value).cast("long") if kind == "long" else F.lit(value), kind, value)


def family(kind: str) -> str:
    return "num" if kind in NUMBERS else "time" if kind in ("date", "ts") else kind


def parse_date(text: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text) if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else None
    except ValueError:
        return None


def parse_timestamp(text: str) -> dt.datetime | None:
    try:
        return dt.datetime.fromisoformat(text) if re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", text) else None
    except ValueError:
        return None


def as_text(x: Typed) -> Column:
    """How a value reads where kinds mix."""
    if x.kind == "bool":
        return F.when(x.col, F.lit("TRUE")).when(~x.col, F.lit("FALSE"))
    if x.kind == "ts":
        return F.date_format(x.col, "yyyy-MM-dd HH:mm:ss")
    return x.col.cast("string")


def unify(xs: list[Typed]) -> tuple[list[Column], str]:
    """Branches of CASE, COALESCE and UNION under one kind: numbers widen, other mixtures read as text."""
    kinds = {x.kind for x in xs} - {"null"}
    if len(kinds) <= 1:
        kind = next(iter(kinds), "null")
        return [x.col for x in xs], kind
    if kinds <= set(NUMBERS):
        return [x.col.cast("double") for x in xs], "double"
    if kinds == {"date", "ts"}:
        return [x.col.cast("timestamp_ntz") for x in xs], "ts"
    return [as_text(x) if x.kind != "null" else F.lit(None).cast("string") for x in xs], "str"


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"=": a.eqNullSafe, "!=": a.__ne__, ">": a.__gt__, "<": a.__lt__, ">=": a.__ge__, "<=": a.__le__}[op](b)


_TURNED = {"=": "=", "!=": "!=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}


def compare(op: str, a: Typed, b: Typed) -> Column:
    """A predicate that is true, false or null; null stands for false until a NOT comes over it.

    Null equals null; kinds of different families are neither equal nor ordered; booleans have no order. Equality stays
    a bare null-safe equality, so that joins on it hash."""
    if op == "LIKE":
        # patterns have no escape character: one that doesn't occur takes that place
        return F.like(a.col, b.col, F.lit("\x00")) if a.kind == b.kind == "str" else F.lit(False)
    if a.kind == "null" or b.kind == "null":
        if op != "=":
            return F.lit(False)
        return b.col.isNull() if a.kind == "null" else a.col.isNull()
    fa, fb = family(a.kind), family(b.kind)
    if {fa, fb} == {"time", "str"}:
        return _time_text(op, a, b) if fa == "time" else _time_text(_TURNED[op], b, a)
    if fa != fb or fa == "other":
        # never equal unless both are null
        return (a.col.isNull() & b.col.isNull()) if op == "=" else F.lit(False)
    if fa == "bool" and op not in ("=", "!="):
        return F.lit(False)
    if fa == "time" and a.kind != b.kind:
        return _apply(op, a.col.cast("timestamp_ntz"), b.col.cast("timestamp_ntz"))
    return _apply(op, a.col, b.col)


def _time_text(op: str, t: Typed, s: Typed) -> Column:
    """A date or timestamp against text. A literal of that type compares as one and can be pushed down."""
    if s.is_literal:
        date, stamp = parse_date(s.value), parse_timestamp(s.value)
        if t.kind == "date" and date is not None:
            return _apply(op, t.col, F.lit(date))
        if t.kind == "ts" and stamp is not None:
            return _apply(op, t.col, F.lit(stamp.isoformat(sep=" ")).cast("timestamp_ntz"))
        if t.kind == "ts" and date is not None:  # as text, a day comes just before its midnight
            midnight = F.lit(f"{date} 00:00:00").cast("timestamp_ntz")
            return {"=": t.col.isNull() & F.lit(False), "!=": t.col.isNotNull(), ">": t.col >= midnight, ">=": t.col >= midnight, "<": t.col < midnight, "<=": t.col < midnight}[op]
    return _apply(op, as_text(t), s.col)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    """+ - * and /; whole numbers divide to whole numbers, toward zero; by zero and on other kinds the result is null."""
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return Typed(F.lit(None).cast("double"), "null")
    whole = a.kind == b.kind == "long"
    x, y = (a.col.cast("long"), b.col.cast("long")) if whole else (a.col.cast("double"), b.col.cast("double"))
    if op == "/":
        if whole:
            return Typed(F.call_function("div", x, F.nullif(y, F.lit(0).cast("long"))), "long")
        return Typed(F.try_divide(x, y), "double")
    return Typed({"+": x + y, "-": x - y, "*": x * y}[op], "long" if whole else "double")


def scalar_function(name: str, args: list[Typed]) -> Typed:
    if name == "COALESCE":
        cols, kind = unify(args)
        return Typed(F.coalesce(*cols), kind)
    if name == "NULLIF":
        a, b = args
        same = F.coalesce(compare("=", a, b), F.lit(False))
        return Typed(F.when(~same, a.col), a.kind)
    (x,) = args
    if x.kind in ("date", "ts"):
        x = Typed(as_text(x), "str")
    if x.kind != "str":
        return Typed(F.lit(None).cast("long" if name == "LENGTH" else "string"), "long" if name == "LENGTH" else "str")
    if name == "LENGTH":
        return Typed(F.octet_length(x.col).cast("long"), "long")
    made = {"UPPER": F.upper, "LOWER": F.lower, "TRIM": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")}[name](x.col)
    return Typed(made, "str")


def aggregate(name: str, x: Typed | None, distinct: bool = False) -> Typed:
    if x is None:
        return Typed(F.count(F.lit(1)), "long") if name == "COUNT" else Typed(F.max(F.lit(None).cast("double")), "null")
    if name == "COUNT":
        return Typed(F.count_distinct(x.col) if distinct else F.count(x.col), "long")
    if name in ("MIN", "MAX"):
        return Typed((F.min if name == "MIN" else F.max)(x.col), x.kind)
    numeric = x.kind in NUMBERS
    if name == "SUM":
        if not numeric:
            return Typed(F.coalesce(F.sum(F.lit(0).cast("long")), F.lit(0).cast("long")), "long")
        zero = F.lit(0).cast("long") if x.kind == "long" else F.lit(0.0)
        return Typed(F.coalesce((F.sum_distinct if distinct else F.sum)(x.col), zero), x.kind)
    if not numeric:
        return Typed(F.max(F.lit(None).cast("double")), "double")
    if distinct:
        return Typed(F.try_divide(F.sum_distinct(x.col.cast("double")), F.count_distinct(x.col)), "double")
    return Typed(F.avg(x.col), "double")


def value_for(value: Any, sql_type: str, column: str) -> Any:
    """A literal as a column of that type stores it, or a TypeMismatch."""
    if value is None:
        return None
    bad = TypeMismatch(f"{column} is {sql_type}, not {value!r}")
    if sql_type == "BOOLEAN":
        if isinstance(value, bool):
            return value
        raise bad
    if isinstance(value, bool):
        raise bad
    if sql_type == "INT" and isinstance(value, int):
        return value
    if sql_type in ("FLOAT", "DOUBLE") and isinstance(value, int | float):
        return float(value)
    if isinstance(value, str):
        got = {"VARCHAR": lambda: value, "DATE": lambda: parse_date(value), "TIMESTAMP": lambda: parse_timestamp(value)}.get(sql_type, lambda: None)()
        if got is not None:
            return got
    raise bad

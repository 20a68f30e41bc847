"""Managed tables as versioned Parquet under a root folder, with one JSON manifest.

A write adds Parquet files under a new name and then replaces the manifest in one step, so a statement is seen whole or
not at all, and DataFrames made before it still read the files they were planned on.  Appending adds a part, and merges
the smaller half of the parts where there are many; updates, deletes and alterations write a new set of parts.  Old files
go with ``vacuum``.  Changes hold a lock on the root folder and begin from the manifest as it is by then, so several
engines may write to one root; reads notice a manifest that others have replaced.

The order of insertion is a number per row: the partition that wrote it in the upper bits, its place there in the lower
ones.  Numbers of rows over a whole table are offsets of partitions plus places within them; nothing is ordered as a whole.
"""

from __future__ import annotations

import fcntl
import functools
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import (
    ColumnCountMismatch, ColumnNotFound, DuplicateKey, ForeignKeyViolation, IndexAlreadyExists, IndexNotFound, InvalidSchema, NullConstraint,
    TableAlreadyExists, TableNotFound, TypeMismatch,
)
from millrace.functions.types import SQL_TYPES, Typed, kind_of, value_for
from millrace.plans.nodes import ColumnDef

#: The hidden column that keeps the order of insertion.
RID = "_rid"
#: Parts of a table beyond which an append merges the smaller half of them.
MOST_PARTS = 64
#: Bits of a row's number that are its place within the partition that wrote it.
PLACE_BITS = 33


def _change(method: Callable[..., Any]) -> Callable[..., Any]:
    """A method that changes the manifest: alone, and from its present state on."""

    @functools.wraps(method)
    def run(self: Catalog, *args: Any, **how: Any) -> Any:
        with self.changing():
            return method(self, *args, **how)

    return run


class Catalog:
    def __init__(self, spark: SparkSession, root: str | os.PathLike[str]) -> None:
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)
        self._at = self.root / "manifest.json"
        self._held: dict[str, Any] | None = None
        self._seen: tuple[int, int] | None = None
        self._depth = 0

    # -- manifest
    def _stamp(self) -> tuple[int, int] | None:
        try:
            s = self._at.stat()
        except FileNotFoundError:
            return None
        return s.st_ino, s.st_mtime_ns

    @property
    def _m(self) -> dict[str, Any]:
        if self._held is None or (not self._depth and self._stamp() != self._seen):
            self._seen = self._stamp()
            self._held = json.loads(self._at.read_text()) if self._seen else {"tables": {}, "views": {}, "indexes": {}}
        return self._held

    @contextmanager
    def changing(self) -> Iterator[None]:
        """Holds the root folder's lock; the outermost one begins from the manifest as it is then. What a failed change
        left in memory is dropped."""
        if self._depth:
            yield
            return
        with open(self.root / ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            self._held = None
            _ = self._m
            self._depth = 1
            try:
                yield
            except BaseException:
                self._held = None
                raise
            finally:
                self._depth = 0

    def _save(self) -> None:
        part = self.root / f".manifest-{uuid.uuid4().hex}"
        part.write_text(json.dumps(self._m, indent=1))
        os.replace(part, self._at)
        self._seen = self._stamp()

    def _table(self, name: str) -> dict[str, Any]:
        if name not in self._m["tables"]:
            raise TableNotFound(name)
        return self._m["tables"][name]

    def list_tables(self) -> list[str]:
        return sorted(self._m["tables"])

    def table_exists(self, name: str) -> bool:
        return name in self._m["tables"]

    def load_schema(self, name: str) -> list[ColumnDef]:
        return [ColumnDef(**{**c, "references": tuple(c["references"]) if c["references"] else None}) for c in self._table(name)["columns"]]

    def column(self, table: str, name: str) -> ColumnDef:
        for c in self.load_schema(table):
            if c.name == name:
                return c
        raise ColumnNotFound(f"{table}.{name}")

    @staticmethod
    def struct(columns: list[ColumnDef]) -> T.StructType:
        return T.StructType([T.StructField(c.name, SQL_TYPES[c.type][0]) for c in columns] + [T.StructField(RID, T.LongType())])

    def _set_columns(self, name: str, columns: list[ColumnDef]) -> None:
        self._table(name)["columns"] = [c.__dict__ for c in columns]

    # -- scans
    def read(self, name: str) -> DataFrame:
        """All rows, with the hidden order column."""
        t = self._table(name)
        schema = self.struct(self.load_schema(name))
        return self._parts(t["parts"], schema)

    def _parts(self, parts: list[str], schema: T.StructType) -> DataFrame:
        paths = [str(self.root / p) for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read_rows(self, name: str) -> list[tuple[Any, ...]]:
        return [tuple(r) for r in self.read(name).orderBy(RID).drop(RID).collect()]

    def read_rows_by_numbers(self, name: str, numbers: list[int]) -> list[tuple[Any, ...]]:
        """Rows by their place in order of insertion, from 0."""
        if not numbers:
            return []
        rows = self.read(name)
        part = F.shiftright(RID, PLACE_BITS)
        before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
        parts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).select("_p", "n", F.coalesce(before, F.lit(0)).alias("_before"))
        asked = self.spark.createDataFrame([(int(n),) for n in set(numbers)], "_n long")
        hit = parts.join(asked, (F.col("_n") >= F.col("_before")) & (F.col("_n") < F.col("_before") + F.col("n"))).select("_p", "_before").distinct().collect()
        if not hit:
            return []
        # the partitions that hold them are read, by a range of the row numbers each
        wanted = functools.reduce(lambda a, b: a | b, [(F.col(RID) >= (r["_p"] << PLACE_BITS)) & (F.col(RID) < ((r["_p"] + 1) << PLACE_BITS)) for r in hit])
        offset = F.create_map(*[F.lit(x) for r in hit for x in (r["_p"], r["_before"])])
        at = rows.where(wanted).withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(RID)) - 1 + offset[part])
        return [tuple(r) for r in at.where(F.col("_n").isin(*numbers)).orderBy("_n").drop("_n", RID).collect()]

    # -- tables
    @_change
    def create_table(self, name: str, columns: list[ColumnDef]) -> None:
        if self.table_exists(name):
            raise TableAlreadyExists(name)
        names = [c.name for c in columns]
        if not names or len(set(names)) < len(names) or RID in names:
            raise InvalidSchema("a table needs columns of different names")
        self._m["tables"][name] = {"columns": [c.__dict__ for c in columns], "parts": [], "next_rid": 0, "seq": 0}
        self._save()

    @_change
    def drop_table(self, name: str, if_exists: bool = False) -> bool:
        if not self.table_exists(name):
            if if_exists:
                return False
            raise TableNotFound(name)
        del self._m["tables"][name]
        self._m["indexes"] = {i: x for i, x in self._m["indexes"].items() if x["table"] != name}
        self._save()
        return True

    def _write(self, name: str, df: DataFrame) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        out = df.write.option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in {x["column"] for x in self._m["indexes"].values() if x["table"] == name}:
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
        out.parquet(str(self.root / part))
        return part

    @_change
    def replace(self, name: str, df: DataFrame, change: Callable[[], None] | None = None) -> None:
        """New rows (with the order column) for a table; ``change`` edits the manifest in the same step."""
        part = self._write(name, df)
        if change is not None:
            change()
        self._table(name)["parts"] = [part]
        self._save()

    @_change
    def vacuum(self) -> None:
        """Removes files that no table refers to any more."""
        used = {p for t in self._m["tables"].values() for p in t["parts"]}
        for folder in self.root.iterdir():
            if folder.is_dir():
                for part in folder.iterdir():
                    if f"{folder.name}/{part.name}" not in used:
                        shutil.rmtree(part)

    @_change
    def add_column(self, name: str, column: ColumnDef) -> None:
        columns = self.load_schema(name)
        if column.name in [c.name for c in columns] or column.name == RID:
            raise InvalidSchema(f"{column.name} is there already")
        rows = self.read(name)
        if (column.not_null or column.primary_key) and not rows.isEmpty():
            raise InvalidSchema(f"{column.name} would hold nulls")
        new = rows.withColumn(column.name, F.lit(None).cast(SQL_TYPES[column.type][0]))
        self.replace(name, new, lambda: self._set_columns(name, [*columns, column]))

    @_change
    def drop_column(self, name: str, column: str) -> None:
        columns = self.load_schema(name)
        self.column(name, column)
        if len(columns) == 1:
            raise InvalidSchema("a table needs a column")
        for other in self.list_tables():
            if any(c.references == (name, column) for c in self.load_schema(other) if (other, c.name) != (name, column)):
                raise ForeignKeyViolation(f"{other} refers to {name}.{column}")

        def change() -> None:
            self._set_columns(name, [c for c in columns if c.name != column])
            self._m["indexes"] = {i: x for i, x in self._m["indexes"].items() if (x["table"], x["column"]) != (name, column)}

        self.replace(name, self.read(name).drop(column), change)

    @_change
    def rename_column(self, name: str, old: str, new: str) -> None:
        columns = self.load_schema(name)
        self.column(name, old)
        if new != old and (new in [c.name for c in columns] or new == RID):
            raise InvalidSchema(f"{new} is there already")

        def change() -> None:
            self._set_columns(name, [ColumnDef(**{**c.__dict__, "name": new}) if c.name == old else c for c in columns])
            self._retarget(lambda r: (name, new) if r == (name, old) else r)
            for x in self._m["indexes"].values():
                if (x["table"], x["column"]) == (name, old):
                    x["column"] = new

        self.replace(name, self.read(name).withColumnRenamed(old, new), change)

    @_change
    def rename_table(self, name: str, new: str) -> None:
        self._table(name)
        if new == name:
            return
        if self.table_exists(new):
            raise TableAlreadyExists(new)
        self._m["tables"][new] = self._m["tables"].pop(name)
        self._retarget(lambda r: (new, r[1]) if r[0] == name else r)
        for x in self._m["indexes"].values():
            if x["table"] == name:
                x["table"] = new
        self._save()

    def _retarget(self, to: Callable[[tuple[str, str]], tuple[str, str]]) -> None:
        for t in self._m["tables"].values():
            for c in t["columns"]:
                if c["references"]:
                    c["references"] = list(to(tuple(c["references"])))

    # -- views
    @_change
    def create_view(self, name: str, text: str) -> None:
        if name in self._m["views"]:
            raise TableAlreadyExists(name)
        self._m["views"][name] = text
        self._save()

    def load_view(self, name: str) -> str | None:
        return self._m["views"].get(name)

    def view_exists(self, name: str) -> bool:
        return name in self._m["views"]

    @_change
    def drop_view(self, name: str, if_exists: bool = False) -> bool:
        if name not in self._m["views"]:
            if if_exists:
                return False
            raise TableNotFound(name)
        del self._m["views"][name]
        self._save()
        return True

    # -- indexes: uniqueness, and Bloom filters on the column in every file, by which a lookup passes over row groups
    def load_index_meta(self) -> dict[str, dict[str, Any]]:
        return dict(self._m["indexes"])

    def find_index(self, table: str, column: str) -> str | None:
        return next((i for i, x in self._m["indexes"].items() if (x["table"], x["column"]) == (table, column)), None)

    @_change
    def create_index(self, name: str, table: str, column: str, unique: bool = False) -> None:
        if name in self._m["indexes"]:
            raise IndexAlreadyExists(name)
        self.column(table, column)
        if unique and not self._repeats(self.read(table), column).isEmpty():
            raise DuplicateKey(f"{table}.{column} has repeated values")
        self._m["indexes"][name] = {"table": table, "column": column, "unique": unique}
        if self._table(table)["parts"]:
            self.replace(table, self.read(table))
        self._save()

    @_change
    def drop_index(self, name: str) -> None:
        if name not in self._m["indexes"]:
            raise IndexNotFound(name)
        del self._m["indexes"][name]
        self._save()

    def lookup_index(self, name: str, value: Any) -> DataFrame:
        """Rows whose indexed column equals a value; null finds nulls."""
        if name not in self._m["indexes"]:
            raise IndexNotFound(name)
        x = self._m["indexes"][name]
        return self.read(x["table"]).where(F.col(x["column"]).eqNullSafe(F.lit(value))).drop(RID)

    # -- constraints, each as one set-wise query
    @staticmethod
    def _repeats(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)

    def _unique_columns(self, name: str) -> list[str]:
        own = [c.name for c in self.load_schema(name) if c.primary_key or c.unique]
        more = [x["column"] for x in self._m["indexes"].values() if x["table"] == name and x["unique"]]
        return list(dict.fromkeys(own + more))

    def _check_nulls(self, name: str, rows: DataFrame, only: set[str] | None = None) -> None:
        must = [c.name for c in self.load_schema(name) if (c.not_null or c.primary_key) and (only is None or c.name in only)]
        if must:
            first = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in must]).first()
            for c in must:
                if first[c]:
                    raise NullConstraint(f"{name}.{c}")

    def _check_parents(self, name: str, rows: DataFrame, only: set[str] | None = None) -> None:
        for c in self.load_schema(name):
            if c.references and (only is None or c.name in only):
                table, column = c.references
                parent = self.read(table).select(F.col(column).alias("_k"))
                if table == name:
                    parent = parent.union(rows.select(F.col(column).alias("_k")))
                child = rows.where(F.col(c.name).isNotNull()).select(F.col(c.name).alias("_c"))
                if not child.join(parent, F.col("_c") == F.col("_k"), "left_anti").limit(1).isEmpty():
                    raise ForeignKeyViolation(f"{name}.{c.name} has a value that isn't in {table}.{column}")

    # -- writes
    def insert_row(self, name: str, values: tuple[Any, ...]) -> int:
        return self.insert_values(name, [values])

    @_change
    def insert_values(self, name: str, rows: list[tuple[Any, ...]]) -> int:
        columns = self.load_schema(name)
        for r in rows:
            if len(r) != len(columns):
                raise ColumnCountMismatch(f"{name} has {len(columns)} columns, not {len(r)}")
        made = [tuple(value_for(v, c.type, c.name) for v, c in zip(r, columns)) for r in rows]
        schema = T.StructType([*self.struct(columns).fields[:-1], T.StructField(RID, T.LongType())])
        return self._append(name, self.spark.createDataFrame([(*r, i) for i, r in enumerate(made)], schema))

    @_change
    def insert_frame(self, name: str, df: DataFrame, kinds: list[str]) -> int:
        """Appends by place, after checking; all rows or none."""
        columns = self.load_schema(name)
        if len(df.columns) != len(columns):
            raise ColumnCountMismatch(f"{name} has {len(columns)} columns, not {len(df.columns)}")
        rows, bad = df.toDF(*[f"_c{i}" for i in range(len(columns))]), []
        out = []
        for i, (c, kind) in enumerate(zip(columns, kinds)):
            spark_type, wanted = SQL_TYPES[c.type]
            col = F.col(f"_c{i}")
            if kind == "str" and wanted in ("date", "ts"):
                cast = F.try_to_date(col) if wanted == "date" else F.try_to_timestamp(col).cast("timestamp_ntz")
                bad.append(F.count_if(cast.isNull() & col.isNotNull()))
                col = cast
            elif not (kind in (wanted, "null") or (kind, wanted) == ("long", "double")):
                raise TypeMismatch(f"{name}.{c.name} is {c.type}, not {kind}")
            out.append(col.cast(spark_type).alias(c.name))
        if bad and any(rows.agg(*[b.alias(f"b{i}") for i, b in enumerate(bad)]).first()):
            raise TypeMismatch(f"text that is no date or timestamp for {name}")
        numbered = rows.select(*out).withColumn(RID, F.monotonically_increasing_id())
        return self._append(name, numbered)

    def _append(self, name: str, rows: DataFrame) -> int:
        """``rows`` have the table's columns and some order column. They are written once; checks read what is written."""
        t, columns = self._table(name), self.load_schema(name)
        auto = [c.name for c in columns if c.auto_increment]
        start, seq = t["next_rid"], t["seq"]
        given = 0
        if auto:
            # one counter a table: partitions are counted first, then number their rows from their own offsets on
            raw = self._write(name, rows)
            rows = self._parts([raw], self.struct(columns))
            part = F.shiftright(RID, PLACE_BITS)
            upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
            counts = rows.groupBy(part.alias("_p")).agg(*[F.count_if(F.col(a).isNull()).alias(f"n{i}") for i, a in enumerate(auto)])
            offsets = counts.select("_p", *[F.coalesce(F.sum(f"n{i}").over(upto), F.lit(0)).alias(f"before{i}") for i in range(len(auto))])
            given = max(x or 0 for x in counts.agg(*[F.sum(f"n{i}") for i in range(len(auto))]).first())
            rows = rows.withColumn("_p", part).join(offsets, "_p")
            for i, a in enumerate(auto):
                count = F.sum(F.col(a).isNull().cast("long")).over(Window.partitionBy("_p").orderBy(RID))
                rows = rows.withColumn(a, F.coalesce(F.col(a), F.lit(seq) + F.col(f"before{i}") + count))
            rows = rows.select(*self.struct(columns).names)
        staged = self._write(name, rows.withColumn(RID, F.col(RID) + start))
        if auto:
            shutil.rmtree(self.root / raw, ignore_errors=True)
        new = self.spark.read.schema(self.struct(columns)).parquet(str(self.root / staged))
        stats = new.agg(F.count("*"), F.max(RID)).first()
        try:
            self._check_nulls(name, new)
            unique = self._unique_columns(name)
            old = self.read(name) if unique else None
            for c in unique:
                if not self._repeats(new, c).isEmpty():
                    raise DuplicateKey(f"{name}.{c}")
                if old is not None and t["parts"] and not old.join(new.where(F.col(c).isNotNull()).select(c), c, "left_semi").limit(1).isEmpty():
                    raise DuplicateKey(f"{name}.{c}")
            self._check_parents(name, new)
        except Exception:
            shutil.rmtree(self.root / staged, ignore_errors=True)
            if auto:  # numbers that were given out stay so
                t["seq"] = seq + given
                self._save()
            raise
        t["parts"] = [*t["parts"], staged]
        sizes = t.setdefault("rows", {})
        sizes[staged] = int(stats[0])
        if stats[1] is not None:
            t["next_rid"] = ((stats[1] >> PLACE_BITS) + 1) << PLACE_BITS  # so that each append has partitions of its own
        if auto:
            t["seq"] = seq + given
        if len(t["parts"]) > MOST_PARTS:
            # the smaller half becomes one part, so a row is written again as often as its part's size doubles
            small = sorted(t["parts"], key=lambda p: sizes.get(p, 1 << 62))[: MOST_PARTS // 2]
            merged = self._write(name, self._parts(small, self.struct(columns)))
            sizes[merged] = sum(sizes.get(p, 0) for p in small)
            t["parts"] = [p for p in t["parts"] if p not in small] + [merged]
        t["rows"] = {p: n for p, n in sizes.items() if p in t["parts"]}
        self._save()
        return int(stats[0])

    @_change
    def update_frame(self, name: str, new: DataFrame, sets: list[tuple[str, Typed]]) -> int:
        """``new``: the rows with ``_hit``. Uniqueness and parents are checked as on insert."""
        schema = self.struct(self.load_schema(name))
        for column, value in sets:
            c = self.column(name, column)
            spark_type, wanted = SQL_TYPES[c.type]
            if value.is_literal:
                col = F.lit(value_for(value.value, c.type, column))
            elif value.kind in (wanted, "null") or (value.kind, wanted) == ("long", "double"):
                col = value.col
            else:
                raise TypeMismatch(f"{name}.{column} is {c.type}, not {value.kind}")
            new = new.withColumn(f"_new_{column}", F.when(F.col("_hit"), col.cast(spark_type)).otherwise(F.col(column)))
        changed = {column for column, _ in sets}
        final = new.select(*[F.col(f"_new_{c}").alias(c) if c in changed else F.col(c) for c in schema.names])
        n = new.where("_hit").count()
        if not n:
            return 0
        staged = self._write(name, final)
        written = self.spark.read.schema(schema).parquet(str(self.root / staged))
        try:
            self._check_nulls(name, written, changed)
            for c in self._unique_columns(name):
                if c in changed and not self._repeats(written, c).isEmpty():
                    raise DuplicateKey(f"{name}.{c}")
            self._check_parents(name, written, changed)
        except Exception:
            shutil.rmtree(self.root / staged, ignore_errors=True)
            raise
        self._table(name)["parts"] = [staged]
        self._save()
        return n

    @_change
    def delete_frame(self, name: str, rows: DataFrame) -> int:
        """``rows`` with ``_hit``; a row whose primary key another row still refers to can't go."""
        gone = rows.where("_hit")
        n = gone.count()
        if not n:
            return 0
        for key in [c.name for c in self.load_schema(name) if c.primary_key]:
            for other in self.list_tables():
                for c in self.load_schema(other):
                    if c.references == (name, key):
                        child = rows.where("not _hit").select(F.col(c.name).alias("_c")) if other == name else self.read(other).select(F.col(c.name).alias("_c"))
                        if not child.join(gone.select(F.col(key).alias("_k")), F.col("_c") == F.col("_k"), "left_semi").limit(1).isEmpty():
                            raise ForeignKeyViolation(f"{other}.{c.name} refers to {name}.{key}")
        self.replace(name, rows.where("not _hit").select(*self.struct(self.load_schema(name)).names))
        return n


def kinds_of(df: DataFrame) -> list[str]:
    return [kind_of(f.dataType) for f in df.schema.fields]


__all__ = ["RID", "Catalog", "kinds_of"]

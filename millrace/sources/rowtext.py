"""Import of tables kept as tagged text: one line a row, cells ``TAG:value`` between bars, backslashes before bars,
newlines (as n) and backslashes; beside each ``name.data`` a ``name.schema`` with a column a line."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidSchema
from millrace.functions.types import SQL_TYPES
from millrace.plans.nodes import ColumnDef
from millrace.sources.catalog import Catalog

_CELL = r"(?:^|\|)((?:[^|\\]|\\.)*)"


def read_schema(text: str) -> tuple[str, list[ColumnDef]]:
    """A table's name and columns from the text of its schema file."""
    name, *lines = [x for x in text.splitlines() if x.strip()]
    columns = []
    for line in lines:
        column, kind, *flags = line.split(":")
        base, _, length = kind.partition("(")
        if base not in SQL_TYPES:
            raise InvalidSchema(f"no type {kind}")
        parent = next((f[3:].split(".") for f in flags if f.startswith("FK=")), None)
        columns.append(ColumnDef(column, base, int(length.rstrip(")")) if length else None, "NOT_NULL" in flags, "UNIQUE" in flags, "AUTO_INCREMENT" in flags, "PRIMARY_KEY" in flags, (parent[0], parent[1]) if parent else None))
    return name, columns


def _plain(cell: Column) -> Column:
    """A text cell without its escapes; doubled backslashes step aside first."""
    cell = F.regexp_replace(cell, r"\\\\", "\x00")
    cell = F.regexp_replace(F.regexp_replace(cell, r"\\n", "\n"), r"\\\|", "|")
    return F.regexp_replace(cell, "\x00", r"\\")


def read_rows(spark: SparkSession, path: str, columns: list[ColumnDef]) -> DataFrame:
    """The rows of a data file. A cell whose value doesn't fit its column's type is an error when it is read."""
    cells = F.regexp_extract_all("value", F.lit(_CELL), 1)
    rows = spark.read.text(path).where("value <> ''").select(cells.alias("c"))
    out = []
    for i, c in enumerate(columns):
        cell = F.col("c")[i]
        value = F.when(cell != "NULL", F.regexp_replace(cell, r"(?s)^(INT|FLOAT|BOOL|STRING):", ""))
        kind = SQL_TYPES[c.type][0]
        out.append((_plain(value) if isinstance(kind, T.StringType) else value.cast(kind)).alias(c.name))
    return rows.select(*out)


def import_folder(catalog: Catalog, folder: str) -> list[str]:
    """Makes managed tables of all schema and data files in a folder; returns their names."""
    found = {name: (columns, p.with_suffix(".data")) for p in sorted(Path(folder).glob("*.schema")) for name, columns in [read_schema(p.read_text())]}
    for name, (columns, _) in found.items():
        catalog.create_table(name, columns)
    parents_first = sorted(found, key=lambda n: sum(1 for c in found[n][0] if c.references))
    for name in parents_first:
        columns, data = found[name]
        if data.exists() and data.stat().st_size:
            catalog.insert_frame(name, read_rows(catalog.spark, str(data), columns), [SQL_TYPES[c.type][1] for c in columns])
    return sorted(found)

"""What the operators share: code shipping, checkpoints in the shared folder, Arrow batch helpers."""

from __future__ import annotations

import atexit
import functools
import inspect
import os
import tempfile
import uuid
import warnings
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch sent to a Python worker: whichever is reached first ends it, so long texts come in
#: batches of few rows and a worker holds one text more than the bytes at most.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

#: ASCII white space, as in the class ``[\x20\x09-\x0D]``; everything else is part of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
LAST_ID = 2**63 - 1

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ready(spark: SparkSession) -> SparkSession:
    """Ships this package to the executors once per application and bounds Arrow batches. The bounds stay in the session,
    as plans are lazy and read them when they run; they are only ever lowered."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        if root.is_dir():  # not when this already runs from a shipped archive
            at = os.path.join(tempfile.mkdtemp(), "millrace_code.zip")
            with zipfile.ZipFile(at, "w") as z:
                for p in sorted((root / "millrace").rglob("*.py")):
                    z.write(p, p.relative_to(root))
            sc.addPyFile(at)
        _shipped.add(sc.applicationId)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key, None) or "")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset and all
    executors are on this machine. On a cluster an unset folder is an error: a machine's own folder isn't shared."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        warnings.warn("spark.checkpoint.dir is unset: intermediate tables go to a folder of this machine", stacklevel=2)
        at = "file://" + os.path.join(tempfile.gettempdir(), "millrace-shared-" + spark.sparkContext.applicationId)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver's Python ends."""
    at = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def settled(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns a scan of it: a checkpoint that cuts the
    lineage, survives lost executors and, unlike an RDD checkpoint, stays columnar."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove_path(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unsettle(df: DataFrame) -> None:
    """Deletes a table made by ``settled`` once nothing reads it any more."""
    for f in {os.path.dirname(p) for p in df.inputFiles()}:
        if "/millrace-" in f:
            remove_path(df.sparkSession, f)


@atexit.register
def _clean() -> None:
    for spark, at in _written:
        try:
            remove_path(spark, at)
        except Exception:  # noqa: BLE001 - the session may be gone; the files are then the cluster's to remove
            continue


def column_at(names: list[str], name: str) -> int:
    """The place of a column: by its exact name, else as Spark resolves it, whatever its case."""
    if name in names:
        return names.index(name)
    found = [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"there {'is no' if not found else 'are several'} column {name!r} among {names}")
    return found[0]


def plain_columns(added: tuple[str, ...] | None, roles: tuple[str, ...]) -> Callable:
    """Lets an operator work on columns c0, c1 …, whatever the table's names are (dots, other cases, the operator's own
    names, the same name twice).  ``roles`` are the operator's parameters that name columns, ``added`` what it adds to
    the table's; a column of the table that an added one clashes with, in any case, is replaced by it.  Without
    ``added`` the operator's result is a table of its own."""

    def wrap(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(op)
        def run(docs: DataFrame, *args: object, **how: object) -> DataFrame:
            call = inspect.signature(op).bind(docs, *args, **how)
            call.apply_defaults()
            names = docs.columns
            plain = [f"c{i}" for i in range(len(names))]
            for role in roles:
                call.arguments[role] = plain[column_at(names, call.arguments[role])]
            call.arguments[next(iter(call.arguments))] = docs.toDF(*plain)
            out = op(*call.args, **call.kwargs)
            if added is None:
                return out
            clash = {a.lower() for a in added}
            keep = [(p, n) for p, n in zip(plain, names) if n.lower() not in clash]
            return out.select(*[p for p, _ in keep], *added).toDF(*[n for _, n in keep], *added)

        return run

    return wrap


def id_key(col: Column) -> Column:
    """Document ids in the order operators use: a null id counts as the largest one."""
    return F.coalesce(col.cast("long"), F.lit(LAST_ID))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 offsets into them; null is empty. No copy unless nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 20):
    """Ranges of rows that together hold up to ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)

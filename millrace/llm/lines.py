"""Line dedup over range-partitioned hashes.

Every line long enough becomes a row (128 bits of BLAKE2b of its key, document, position).  The rows are range-partitioned by
hash, document and position and sorted so within partitions; a stream over a partition then sees a key's lines in the
order of their documents and marks all but the first document's.  A key that a third of all documents hold spreads over
many partitions, as the document is part of the range; where a key goes on over a partition's border, each partition
reports the first document of its last key (one row a partition), which settles the rows at the next one's start.

What comes out per document is a compressed bitmap of the lines to keep, no text.

Defined results: a null id counts as the largest, and rows that share an id are one document (told apart by their text
when lines are dropped); null and empty texts are one empty line; extra columns pass through (clashing ones are replaced);
an empty table gives an empty result.  Keys count as equal where their 128-bit cryptographic hashes are; the lines
themselves aren't compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import SPACES, id_key, plain_columns, ready, settled

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = SPACES.encode()
ADDED = ("kept_text", "n_lines", "n_dropped")
#: Lines that one range of hashes has, so that ranges grow in number and not in size.
RANGE_ROWS = 250_000


def _points(key: bytes) -> int:
    """Code points of UTF-8."""
    return len(key) if key.isascii() else len(key.decode())


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, doc, fp, pos, n): one row for every line whose key has ``least`` code points; docs has doc, fp, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, row, place, size = [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                lines = (text or b"").translate(_LOWER).split(b"\n")
                for p, line in enumerate(lines):
                    key = line.strip(_SPACES)
                    if len(key) >= least and (len(key) >= 4 * least or _points(key) >= least):
                        hashes.append(blake2b(key, digest_size=16).digest())
                        row.append(i)
                        place.append(p)
                        size.append(len(lines))
            h = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
            take = np.array(row, dtype=np.int64)
            ids, fps = batch.column(0).to_numpy()[take], batch.column(1).to_numpy()[take]
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids), pa.array(fps), pa.array(place, pa.int32()), pa.array(size, pa.int32())], names=["h1", "h2", "doc", "fp", "pos", "n"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, fp long, pos int, n int")


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those not in their key's first document (kind 0); the partition's first lines, whose key may
    have begun in an earlier partition (kind 1); last, its last key with that key's first document (kind 2)."""
    names = ["kind", "h1", "h2", "doc", "fp", "pos", "n"]
    key, first, opening = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, fp, pos, n = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key is None or key != (h1[0], h2[0])
        at = np.flatnonzero(new)
        run = np.cumsum(new)  # 0: goes on from the last batch
        firsts = np.concatenate([[first if first is not None else doc[0]], doc[at]])
        gone = doc != firsts[run]
        open_rows = ~gone & (run == (1 if new[0] else 0)) if opening else np.zeros(len(h1), dtype=bool)
        opening = opening and (len(at) == 0 or (len(at) == 1 and bool(new[0])))
        key, first = (h1[-1], h2[-1]), firsts[run[-1]]
        for kind, mask in ((0, gone), (1, open_rows)):
            if mask.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(mask.sum()), kind, np.int32)), *(pa.array(c[mask]) for c in (h1, h2, doc, fp, pos, n))], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([key[0]]), pa.array([key[1]]), pa.array([first]), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32())], names=names)


@plain_columns(None, ("id_col", "text_col"))
def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """doc, fp, keep: for every document that loses lines, its id key, its text's xxhash64 and a zlib-compressed bitmap
    (little-endian bit order) of the lines that stay. A key of ``least`` code points or more, found in two documents,
    stays in the smallest of them only."""
    ready(docs.sparkSession)
    rows = docs.select(id_key(F.col(id_col)).alias("doc"), F.xxhash64(text_col).alias("fp"), F.col(text_col).cast("string").alias("t"))
    keys = settled(line_keys(rows, least), "lines")
    order = ["h1", "h2", "doc", "fp", "pos"]
    marked = settled(keys.repartitionByRange(max(1, -(-keys.count() // RANGE_ROWS)), *order).sortWithinPartitions(*order).mapInArrow(_later, "kind int, h1 long, h2 long, doc long, fp long, pos int, n int"), "marked")
    tails = marked.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("low"))  # at most a row a partition
    late = marked.where("kind = 1").join(F.broadcast(tails), ["h1", "h2"]).where("low < doc")
    gone = marked.where("kind = 0").select("doc", "fp", "pos", "n").union(late.select("doc", "fp", "pos", "n"))

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep = np.ones(n, dtype=np.uint8)
                keep[places] = 0
                made.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc", "fp", "keep"])

    return gone.groupBy("doc", "fp").agg(F.max("n").alias("n"), F.collect_list("pos").alias("places")).mapInArrow(bitmap, "doc long, fp long, keep binary")


@plain_columns(ADDED, ("id_col", "text_col"))
def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with kept_text, n_lines and n_dropped added (a null text is one empty line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, raw in zip(batch.column("mr_text").cast(pa.binary()).to_pylist(), batch.column("keep").to_pylist()):
                lines = (text or b"").split(b"\n")
                stay = lines
                if raw is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(raw), dtype=np.uint8), bitorder="little", count=len(lines))
                    stay = [line for line, k in zip(lines, keep) if k]
                texts.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("mr_text", "keep")]
            names = [name for name in batch.schema.names if name not in ("mr_text", "keep")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "kept_text", "n_lines", "n_dropped"])

    spare = docs.columns
    rows = docs.select(*spare, id_key(F.col(id_col)).alias("mr_doc"), F.xxhash64(text_col).alias("mr_fp"), F.col(text_col).cast("string").alias("mr_text"))
    rows = rows.join(bitmaps.select(F.col("doc").alias("mr_doc"), F.col("fp").alias("mr_fp"), "keep"), ["mr_doc", "mr_fp"], "left").select(*spare, "mr_text", "keep")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*spare).schema)
    return rows.mapInArrow(run, kinds + ", kept_text string, n_lines long, n_dropped long")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """``docs`` with kept_text, n_lines, n_dropped; see ``line_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, least), id_col, text_col)

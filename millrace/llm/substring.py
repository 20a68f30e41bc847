"""Substring dedup with a count-min prefilter.

Pass one: each task sketches its windows.  A sketch row is a bit plane per count, "seen" and "seen again"; as most cells
of one task's sketch are empty it travels as sorted, delta-coded cell numbers, split by range of cells, and the reducer
of a range merges the tasks' sketches into that part of the "seen at least twice" plane, which goes to the shared
folder.  The merged sketch overestimates counts and never underestimates them.

Pass two: tasks re-read the texts and keep the windows whose cells are set in every row.  These are grouped exactly, by
their words.  Windows meet by minimiser: of the ``GRAM``-word sequences in a window the one with the smallest hash, which
is the same in equal windows, so a run of windows of one minimiser travels as one stretch of words and the words
themselves, not hashes of them, are compared where they meet.  A task keeps one document per window for the exchange
(the smallest id it has; it decides on the others itself, again by words), so a passage that a third of all documents
share sends one entry a task.

The sketch takes about 8 bits a window, up to ``most_cells``.  Beyond that cap it lets more unique windows through to the
exact grouping; it never loses one.

Defined results: a null id counts as the largest; rows that repeat an id are one document, told apart by their text when
words are removed; null and empty texts have no words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import fcntl
import hashlib
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _words as W
from millrace.llm._shared import id_key, new_path, plain_columns, ready, slices, text_bytes

DEPTH = 2
#: Words of the sequences that minimisers are taken from: long enough that no phrase of the language draws many windows.
GRAM = 7
#: Words that a task groups at a time.
FLUSH_WORDS = 1 << 20
_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each window in one row of the sketch; rows lie one after the other."""
    return ((h * _SALT[row]) >> np.uint64(64 - bits)) + np.uint64(row << bits)


def _pack(sorted_cells: np.ndarray) -> bytes:
    """Gaps as LEB128-like bytes would be slow to make here; bytes planes of the gaps compress as well."""
    gaps = np.diff(sorted_cells, prepend=np.uint64(0)).astype(np.uint32)
    return zlib.compress(b"".join(((gaps >> np.uint32(8 * i)) & np.uint32(255)).astype(np.uint8).tobytes() for i in range(4)), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1).astype(np.uint64)
    return np.cumsum(planes[0] | planes[1] << np.uint64(8) | planes[2] << np.uint64(16) | planes[3] << np.uint64(24))


def sketch(docs: DataFrame, text_col: str, k: int, bits: int, ranges: int) -> str:
    """Writes the merged "at least twice" plane of all windows to the shared folder, one file per range of cells, and
    returns the folder."""
    spark = docs.sparkSession
    path = new_path(spark, "sketch")
    total = DEPTH << bits
    width = total // ranges  # cells of a range
    flush = 1 << 22

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            cells = np.repeat(cells, np.minimum(counts, 2))  # a count above two says no more than two
            cut = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
            rows = [(r, _pack(cells[a:b] - np.uint64(r * width))) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["r", "cells"])

        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for i, j in slices(off):
                part = data[off[i] : off[j]]
                starts, ends, word_off, _ = W.words(part, off[i : j + 1])
                h = W.windows(W.word_hashes(part, starts, ends), k)[W.inside(word_off, k, len(starts))]
                held += [_cells(h, row, bits) for row in range(DEPTH)]
                n += DEPTH * len(h)
                if n >= flush:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, done = None, None, []
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != at:
                    if at is not None:
                        done.append(_write_plane(path, at, seen))
                    at, seen = r, np.zeros(width, dtype=np.uint8)
                cells, counts = np.unique(_unpack(raw.as_py()), return_counts=True)
                seen[cells] = np.minimum(seen[cells] + counts.astype(np.uint8), 2)
        if at is not None:
            done.append(_write_plane(path, at, seen))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["r"])

    parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(partial, "r int, cells binary")
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    parts.repartitionById(ranges, F.col("r")).sortWithinPartitions("r").mapInArrow(merge, "r int").agg(F.count("*")).first()
    return path


def _write_plane(path: str, r: int, seen: np.ndarray) -> int:
    """One range's bits as a raw file. A task that runs twice writes the same bytes; a move makes each whole."""
    fs, at = pafs.FileSystem.from_uri(path)
    part = f"{at}/.{r}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(np.packbits(seen > 1, bitorder="little").tobytes())
    fs.move(part, f"{at}/{r}.bits")
    return r


def load_sketch(path: str, ranges: int) -> list[np.ndarray | None]:
    """The merged plane by range, mapped, so that it takes page cache and no worker's memory. A shared folder that isn't
    mounted can't be mapped: there each executor keeps a copy beside the files Spark ships to it, made once by the first
    task and again by any executor that takes a lost one's place. A range without windows has no file."""
    fs, at = pafs.FileSystem.from_uri(path)
    folder = at
    if not isinstance(fs, pafs.LocalFileSystem):
        folder = os.path.join(SparkFiles.getRootDirectory(), "sketch-" + hashlib.sha1(path.encode()).hexdigest())
        with open(folder + ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(folder):
                shutil.rmtree(folder + ".part", ignore_errors=True)
                pafs.copy_files(at, folder + ".part", source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
                os.rename(folder + ".part", folder)
    names = [os.path.join(folder, f"{r}.bits") for r in range(ranges)]
    return [np.memmap(name, dtype=np.uint8, mode="r") if os.path.exists(name) else None for name in names]


def set_in(planes: list[np.ndarray | None], cells: np.ndarray, width: int) -> np.ndarray:
    """Which of the cells are set."""
    hit = np.zeros(len(cells), dtype=bool)
    of = (cells // np.uint64(width)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(len(planes) + 1))
    for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        if b > a and planes[r] is not None:
            take = order[a:b]
            c = cells[take] - np.uint64(r * width)
            hit[take] = (planes[r][c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return hit


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a new key begins in two sorted arrays."""
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new


def _minimisers(h: np.ndarray, k: int) -> np.ndarray:
    """For every window of ``k`` words, the smallest hash of the sequences of ``GRAM`` words in it."""
    gram = min(GRAM, k)
    low = W.windows(h, gram)
    width, left = 1, k - gram + 1
    while width < left:  # minima over 1, 2, 4 … sequences
        step = min(width, left - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def _repeated(doc: np.ndarray, at: np.ndarray, key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which windows (of ``k`` words from places ``at`` on) are equal to one of a smaller document, by their words."""
    order, new = W.same_windows(key, at, ids, k)
    first = np.flatnonzero(new)
    ordered = doc[order]
    lowest = np.minimum.reduceat(ordered, first) if len(first) else ordered
    out = np.empty(len(doc), dtype=bool)
    out[order] = ordered > np.repeat(lowest, np.diff(np.append(first, len(order))))
    return out


def _stretches(doc: np.ndarray, fp: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc, fp, places) of windows that lie in order of documents: places as pairs of a first window and how many
    follow each other from it on."""
    if not len(doc):
        return
    text = _runs(doc, fp)
    new = text.copy()
    new[1:] |= pos[1:] != pos[:-1] + 1
    at = np.flatnonzero(new)
    pairs = np.stack([pos[at], np.diff(np.append(at, len(doc)))], axis=1).astype(np.int32)
    rows = np.flatnonzero(text[at])
    cut = np.append(rows, len(at))
    for a in range(0, len(rows), 4096):
        b = min(a + 4096, len(rows))
        where = at[rows[a:b]]
        yield pa.RecordBatch.from_arrays([pa.array(doc[where]), pa.array(fp[where]), pa.array([pairs[cut[x] : cut[x + 1]].tobytes() for x in range(a, b)], pa.binary())], names=["doc", "fp", "places"])


class _Held:
    """Runs of candidate windows that a task holds: their words, each with a space behind it, and where they come from."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.keys: list[np.ndarray] = []
        self.lows: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.n_words = 0

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, h: np.ndarray, low: np.ndarray, doc: np.ndarray, fp: np.ndarray, pos: np.ndarray, k: int) -> None:
        """Windows at word places ``at`` of some texts' bytes."""
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at))) + k - 1
        words = W.ranges(at[first], n)
        size = ends[words] - starts[words] + 1
        padded = np.append(data, np.uint8(32))
        raw = padded[W.ranges(starts[words], size)]
        raw[np.cumsum(size) - 1] = 32
        self.raw.append(raw)
        self.sizes.append(size)
        self.keys.append(h)
        self.lows.append(low)
        self.columns.append((n, doc[first], fp[first], pos[first]))
        self.n_words += len(words)


def repeated_windows(docs: DataFrame, k: int, path: str, bits: int, ranges: int, groups: int, flush: int = FLUSH_WORDS) -> DataFrame:
    """(doc, fp, places): windows that start in a document with a smaller id too. ``docs`` has doc, fp, t."""
    names = ["g", "doc", "fp", "entries"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane, held = None, _Held()
        width = (DEPTH << bits) // ranges

        def out() -> Iterator[pa.RecordBatch]:
            raw, size = np.concatenate(held.raw), np.concatenate(held.sizes)
            n, doc, fp, pos = (np.concatenate([x[i] for x in held.columns]) for i in range(4))
            key, low = np.concatenate(held.keys), np.concatenate(held.lows)
            byte = np.concatenate([[0], np.cumsum(size)])
            ids = W.word_ids(raw, byte[:-1], byte[1:])
            many = n - k + 1
            run = np.repeat(np.arange(len(n)), many)
            at = W.ranges(np.cumsum(n) - n, many)
            place = W.ranges(pos, many)
            known = _repeated(doc[run], at, key, ids, k)  # this task has a smaller document with that window
            for b in _stretches(doc[run[known]], fp[run[known]], place[known]):
                yield pa.RecordBatch.from_arrays([pa.compute.cast(pa.array(b.column(0).to_numpy() % groups), pa.int32()), *b.columns], names=names)
            left = np.flatnonzero(~known)
            if not len(left):
                return
            new = np.ones(len(left), dtype=bool)
            new[1:] = (left[1:] != left[:-1] + 1) | (run[left][1:] != run[left][:-1]) | (low[left][1:] != low[left][:-1])
            cut = np.flatnonzero(new)
            many = np.diff(np.append(cut, len(left)))
            first = left[cut]
            g = (W.mix(low[first]) >> np.uint64(40)).astype(np.int64) * groups >> 24
            order = np.argsort(g, kind="stable")
            g, first, many = g[order], first[order], many[order]
            begin, end = byte[at[first]], byte[at[first] + many + k - 1]
            text = raw[W.ranges(begin, end - begin)]
            upto = np.concatenate([[0], np.cumsum(end - begin)])
            cut = np.searchsorted(g, np.arange(groups + 1))
            made = [(r, _entries(doc[run[first[a:b]]], fp[run[first[a:b]]], place[first[a:b]], many[a:b], text[upto[a] : upto[b]])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            for a in range(0, len(made), 512):
                part = made[a : a + 512]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in part], pa.int32()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()), pa.array([p for _, p in part], pa.binary())], names=names)

        for batch in batches:
            plane = load_sketch(path, ranges) if plane is None else plane
            data, off = text_bytes(batch.column(2))
            ids, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(off):
                part = data[off[i] : off[j]]
                starts, ends, word_off, _ = W.words(part, off[i : j + 1])
                h = W.word_hashes(part, starts, ends)
                hit = np.flatnonzero(W.inside(word_off, k, len(h)))
                w = W.windows(h, k)
                for row in range(DEPTH):
                    hit = hit[set_in(plane, _cells(w[hit], row, bits), width)]
                if len(hit):
                    of = np.searchsorted(word_off, hit, side="right") - 1
                    held.add(part, starts, ends, hit, w[hit], _minimisers(h, k)[hit], ids[i + of], fps[i + of], hit - word_off[of], k)
                if held.n_words >= flush:
                    yield from out()
                    held = _Held()
        if held.n_words:
            yield from out()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            known = batch.filter(pa.compute.is_valid(batch.column(1)))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays(known.columns[1:], names=names[1:3] + ["places"])
            batch = batch.filter(pa.compute.is_null(batch.column(1)))
            for g, raw in zip(batch.column(0).to_pylist(), batch.column(3)):
                if g != at and held:
                    yield from judged(held)
                    held = []
                at = g
                held.append(_entries_of(raw.as_py()))
        if held:
            yield from judged(held)

    def judged(held: list) -> Iterator[pa.RecordBatch]:
        doc, fp, pos, many, raw = (np.concatenate([x[i] for x in held]) for i in range(5))
        byte = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
        ids = W.word_ids(raw, byte[:-1], byte[1:])
        n = many + k - 1
        first = np.cumsum(n) - n
        order = np.lexsort((pos, fp, doc))
        doc, fp, pos, many, first = doc[order], fp[order], pos[order], many[order], first[order]
        run = np.repeat(np.arange(len(many)), many)
        at, place = W.ranges(first, many), W.ranges(pos, many)
        key = W.windows(W.mix(ids.astype(np.uint64) + np.uint64(1)), k)[at]
        gone = _repeated(doc[run], at, key, ids, k)
        yield from _stretches(doc[run[gone]], fp[run[gone]], place[gone])

    found = docs.mapInArrow(candidates, "g int, doc long, fp long, entries binary")
    return found.repartitionById(groups, F.col("g")).sortWithinPartitions("g").mapInArrow(exact, "doc long, fp long, places binary")


_ZSTD = pa.Codec("zstd", compression_level=1)


def _entries(doc: np.ndarray, fp: np.ndarray, pos: np.ndarray, many: np.ndarray, text: np.ndarray) -> bytes:
    """Stretches of one group: documents as a table and an index into it, places, windows, and the words."""
    order = np.lexsort((fp, doc))
    new = _runs(doc[order], fp[order])
    index = np.empty(len(doc), dtype=np.uint32)
    index[order] = np.cumsum(new) - 1
    table = np.stack([doc[order][new], fp[order][new]])
    body = b"".join([np.array([len(doc), table.shape[1]], dtype=np.int64).tobytes(), table.tobytes(), index.tobytes(), pos.astype(np.uint32).tobytes(), many.astype(np.uint32).tobytes(), text.tobytes()])
    return len(body).to_bytes(8, "little") + _ZSTD.compress(body, asbytes=True)


def _entries_of(raw: bytes) -> tuple[np.ndarray, ...]:
    body = _ZSTD.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), asbytes=True)
    n, m = np.frombuffer(body, dtype=np.int64, count=2)
    table = np.frombuffer(body, dtype=np.int64, count=2 * m, offset=16).reshape(2, -1)
    index, pos, many = np.frombuffer(body, dtype=np.uint32, count=3 * n, offset=16 + 16 * m).reshape(3, -1).astype(np.int64)
    return table[0][index], table[1][index], pos, many, np.frombuffer(body, dtype=np.uint8, offset=16 + 16 * m + 12 * n)


@plain_columns(None, ("id_col", "text_col"))
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, most_cells: int = 1 << 36, flush: int = FLUSH_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that stay, joined by one space. A word goes when it is covered by a
    window of ``k`` words that also starts in a document with a smaller id, judged on the input."""
    spark = ready(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    # a window takes 5 bytes of text or more in most languages; 8 bits a window over both rows
    bits = int(np.clip(np.round(np.log2(max(size, 1) / 5 * 8 / DEPTH)), 16, np.log2(most_cells // DEPTH)))
    ranges = max(1, (DEPTH << bits) >> 24)
    path = sketch(docs, text_col, k, bits, ranges)
    rows = docs.select(id_key(F.col(id_col)).alias("doc"), F.xxhash64(text_col).alias("fp"), F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("long").alias("doc_id"))
    groups = int(max(1, size // (8 << 20)))
    hits = repeated_windows(rows.select("doc", "fp", "t"), k, path, bits, ranges, groups, flush)
    places = hits.groupBy("doc", "fp").agg(F.collect_list("places").alias("places"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            data, off = text_bytes(batch.column(1))
            found = batch.column(2).to_pylist()
            for i, j in slices(off):
                part = data[off[i] : off[j]]
                starts, ends, word_off, _ = W.words(part, off[i : j + 1])
                raw = part.tobytes()
                for r in range(i, j):
                    a, b = word_off[r - i], word_off[r - i + 1]
                    stay = np.arange(a, b)
                    if found[r]:
                        at, many = np.frombuffer(b"".join(found[r]), dtype=np.int32).reshape(-1, 2).T
                        edge = np.zeros(b - a + 1, dtype=np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + many + k - 1, -1)
                        stay = stay[np.cumsum(edge[:-1]) == 0]
                    n_words.append(b - a)
                    n_removed.append(b - a - len(stay))
                    kept.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(places, ["doc", "fp"], "left").select("doc_id", "t", "places").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")

"""MinHash near-duplicates with b-bit signatures.

One pass over the texts gives each document its set's size (exact), a SHA-256 of its words, band keys, and a signature
that holds two bits of each minimum (512 of them in sixteen longs).  Documents with the same words collapse into a class
first, so thousands of copies cost one row.  Bands give candidates; the share of equal bits, corrected for chance
collisions, estimates their similarity; candidates near the threshold or above are confirmed on full sets of shingles,
whose words are compared, not hashes of them.  The two bits are the low ones of the minimum after a mix of its own: where
minima are equal the bits are, where they aren't the bits agree by chance alone, in small sets too.

Candidates are not all pairs of a bucket.  First every member meets the bucket's smallest member (the members of one that
has very many in parts, each of which gets its text once); confirmed links give components; only in buckets that still
hold several components do members of different components meet, compared by signature.  A large bucket is cut into
tiles by size and hash, and only tiles whose sizes can be similar meet, two at a time in a task, so a task's memory
doesn't grow with the bucket.  A pair that is left out lies in one component already, so no component changes by it.

Defined results: a null id takes no part (component null, kept); texts without words have an empty set and link with
nothing; rows that repeat an id are one document, represented by the row whose text hashes smallest; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _words as W
from millrace.llm._shared import plain_columns, ready, settled, slices, text_bytes, unsettle

#: 32 bands of 4 minima: a pair at similarity 0.8 shares no band with a probability of 5e-8, at 0.85 of 6e-11.
ROWS, BANDS = 4, 32
#: Minima in a signature, two bits each; the first of them make the bands. An estimate's standard deviation is 0.019 near 0.85.
MINIMA = 512
BITS = 2
LONGS = MINIMA * BITS // 64
SIGNATURE = [f"s{i}" for i in range(LONGS)]
#: An estimate may fall short of the truth by six standard deviations of its own before a candidate is left out.
DEVIATIONS = 6.0
#: Below so many shingles in either set a candidate skips the estimate: its full set is as cheap to compare.
SMALL = 64
#: Pairs of a task that go out together.
PAIRS = 1 << 18
#: Rows of a bucket in one tile. Two tiles meet in a task.
TILE_ROWS = 8192
#: Members that meet one copy of their hub's text.
PART_PAIRS = 256

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
_OWN = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)

FEATURES = "doc_id long, fp long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of some texts, text by text and sorted within each (repeats included), and the offsets."""
    starts, ends, word_off, low = W.words(data, off, lower=True)
    h = W.word_hashes(low, starts, ends)
    n = np.diff(word_off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], dtype=np.uint64)
    full = np.ones(len(out), dtype=bool)
    short = np.flatnonzero((n > 0) & (n < k))
    full[at[short]] = False
    out[full] = W.windows(h, k)[W.inside(word_off, k, len(h))]
    for i in short:
        out[at[i]] = W.whole(h[word_off[i] : word_off[i + 1]])
    for a, b in zip(at[:-1], at[1:]):
        out[a:b].sort()
    return out, at


def shingle_words(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lowered."""
    return (text or b"").translate(W.LOWER).split()  # at ASCII white space


def _signatures(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and packed low bits (texts x LONGS)."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.empty((MINIMA, len(starts)), dtype=np.uint32)
    t = np.empty_like(x)
    for i in range(MINIMA):
        np.multiply(x, _A[i], out=t)
        np.add(t, _B[i], out=t)
        low[i] = np.minimum.reduceat(t, starts)
    keys = np.empty((len(starts), BANDS), dtype=np.uint64)
    for j in range(BANDS):
        key = np.full(len(starts), 0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1), dtype=np.uint64)
        for r in range(ROWS):
            key ^= low[j * ROWS + r]
            W.mix(key)
        keys[:, j] = key
    packed = np.zeros((len(starts), LONGS), dtype=np.uint64)
    for i in range(MINIMA):
        own = W.mix(low[i].astype(np.uint64) ^ _OWN[i]) & np.uint64(3)
        packed[:, i // 32] |= own << np.uint64(2 * (i % 32))
    return keys.view(np.int64), packed.view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """One row per document with an id: set size, digest of the words, band keys and signature (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), *((s, pa.int64()) for s in SIGNATURE)])
        for batch in batches:
            data, off = text_bytes(batch.column(2))
            for i, j in slices(off):
                sets, at = shingle_sets(data[off[i] : off[j]], off[i : j + 1], k)
                n, digest = np.zeros(j - i, dtype=np.int64), [None] * (j - i)
                rows = np.flatnonzero(np.diff(at))
                new = np.ones(len(sets), dtype=bool)
                new[1:] = sets[1:] != sets[:-1]
                new[at[:-1][np.diff(at) > 0]] = True
                upto = np.concatenate([[0], np.cumsum(new)])
                raw = data[off[i] : off[j]].tobytes()
                for r in rows:
                    own = shingle_words(raw[off[i + r] - off[i] : off[i + r + 1] - off[i]])
                    n[r], digest[r] = upto[at[r + 1]] - upto[at[r]], hashlib.sha256(b" ".join(own)).digest()
                    if n[r] < at[r + 1] - at[r]:  # equal hashes: are the words equal?
                        n[r] = W.shingle_count(own, k)
                keys, packed = _signatures(sets, at[rows])
                lens = np.zeros(j - i, dtype=np.int64)
                lens[rows] = BANDS
                none = lens == 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(keys.ravel()))
                sig = np.zeros((j - i, LONGS), dtype=np.int64)
                sig[rows] = packed
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n), pa.array(digest, pa.binary()), bands, *(pa.array(sig[:, c], mask=none) for c in range(LONGS))], schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, FEATURES)


def estimate(a: str, b: str) -> Column:
    """Similarity from two signatures: the share of equal two-bit groups, less what chance makes equal."""
    ones = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        ones = ones + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0**-BITS
    return (F.lit(1.0) - ones / F.lit(float(MINIMA)) - chance) / (1 - chance)


def least_estimate(percent: int, minima: int = MINIMA) -> float:
    j, chance = percent / 100, 2.0**-BITS
    m = j + (1 - j) * chance
    return j - DEVIATIONS * (m * (1 - m) / minima) ** 0.5 / (1 - chance)


def confirmed(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets, compared as words, are as similar as asked; estimates come first, but for
    small sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (a, part) lie together, the one with a's own text (b null) first."""
        mine: list[bytes] = []
        for batch in batches:
            good = []
            for i, (b, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist())):
                own = shingle_words(text)
                if b is None:
                    mine = own
                    continue
                m, n, both = W.shingle_overlap(mine, own, k)
                if 100 * both >= percent * (m + n - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(2).take(pa.array(good, pa.int64()))], names=["a", "b"])

    near = (
        pairs.alias("p").join(sigs.alias("x"), F.col("p.a") == F.col("x.node")).join(sigs.alias("y"), F.col("p.b") == F.col("y.node"))
        .where(100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles"))
        .where((F.least("x.n_shingles", "y.n_shingles") < SMALL) | (estimate("x", "y") >= least_estimate(percent))).select("p.a", "p.b")
    )
    near = settled(near, "near")
    parts = near.groupBy("a").agg(F.ceil(F.count("*") / PART_PAIRS).cast("int").alias("parts"))
    spread = near.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.select(F.col("node").alias("a"), "text"), "a")
    rows = spread.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "part", "b", "text").union(heads.select("a", "part", F.lit(None).cast("long").alias("b"), "text"))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the links (a, b): large-star and small-star
    rounds, each written to the shared folder, until the stars stay as they are."""
    now = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = settled(small, "stars")
        seen = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.countDistinct("v")).first()
        unsettle(now)
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _ended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    """The frames that have rows, then None."""
    for f in frames:
        if len(f):
            yield f
    yield None


def cross_pairs(members: DataFrame, percent: int, tile: int = TILE_ROWS) -> DataFrame:
    """Pairs of different components within a bucket whose signatures are near, or whose smaller set is small: compared
    in blocks, never listed before.  ``members`` has key, node, comp, n_shingles and the signature."""
    wrong_at = lambda minima: int((1 - 2.0**-BITS) * (1 - least_estimate(percent, minima)) * minima)
    head = 4  # longs that are compared for all, the rest for those that pass
    most_head, most_wrong = wrong_at(head * 64 // BITS), wrong_at(MINIMA)
    groups = np.uint64(0x5555555555555555)

    def near_in(node: np.ndarray, comp: np.ndarray, size: np.ndarray, sig: np.ndarray, row: np.ndarray, col: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows of a bucket, or of two tiles of one, against its columns; sorted by size."""
        few, cols = np.flatnonzero(row), np.flatnonzero(col)
        over, sizes = sig[cols], size[cols]
        at = 0
        while at < len(few):
            # sizes too far apart can't be similar: a block of rows meets one range of the sorted sizes
            low = np.searchsorted(sizes, -(-size[few[at]] * percent // 100), side="left")
            rows = few[at : at + max(1, (1 << 16) // max(1, len(cols) - low))]
            high = np.searchsorted(sizes, size[rows[-1]] * 100 // percent, side="right")
            wrong = np.zeros((len(rows), high - low), dtype=np.uint8)
            for c in range(head):
                x = sig[rows, c][:, None] ^ over[low:high, c][None, :]
                x |= x >> np.uint64(1)
                x &= groups
                wrong += np.bitwise_count(x)
            p, q = np.nonzero((wrong <= most_head) | (size[rows] < SMALL)[:, None] | (sizes[low:high] < SMALL)[None, :])
            p, q = rows[p], cols[q + low]
            apart = comp[p] != comp[q]
            p, q = p[apart], q[apart]
            if len(p):
                x = sig[p] ^ sig[q]
                near = np.bitwise_count((x | (x >> np.uint64(1))) & groups).sum(axis=1, dtype=np.int64) <= most_wrong
                near |= np.minimum(size[p], size[q]) < SMALL
                near &= 100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])
                p, q = p[near], q[near]
                yield np.minimum(node[p], node[q]), np.maximum(node[p], node[q])
            at += len(rows)

    def together(made: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame({"a": np.concatenate([x for x, _ in made]), "b": np.concatenate([y for _, y in made])}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket and size. Most buckets have a few rows, so none becomes a frame of its own; what a
        batch cuts off goes on with the next one."""
        rest: list[pd.DataFrame] = []
        for frame in _ended(frames):
            if frame is not None:
                rest.append(frame)
                last = frame[["key", "tile"]].iloc[-1].tolist()
                if len(rest) and rest[0][["key", "tile"]].iloc[0].tolist() == last:
                    continue  # still the same bucket
            if not rest:
                return
            held = pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0].reset_index(drop=True)
            key, tile_ = held["key"].to_numpy(), held["tile"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile_[1:] != tile_[:-1])]))
            cut = np.append(new, len(held))
            if frame is not None:  # the last bucket may go on
                cut, rest = cut[:-1], [held.iloc[cut[-2] :]]
            node, comp, size, row, col = (held[c].to_numpy() for c in ("node", "comp", "n_shingles", "row", "col"))
            sig = held[SIGNATURE].to_numpy(dtype=np.int64).view(np.uint64)
            made, n = [], 0
            for x in (x for i, j in zip(cut[:-1], cut[1:]) for x in near_in(node[i:j], comp[i:j], size[i:j], sig[i:j], row[i:j], col[i:j])):
                made.append(x)
                n += len(x[0])
                if n >= PAIRS:
                    yield together(made)
                    made, n = [], 0
            if made:
                yield together(made)

    # Two members of a bucket's largest component need not meet: the others are the rows, all are columns.
    each = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = each.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    placed = members.join(keys, "key").withColumn("row", F.col("comp") != F.col("main"))
    columns = ["key", "tile", "row", "col", "node", "comp", "n_shingles", *SIGNATURE]
    cells = placed.where(F.col("n") <= tile).select("*", F.lit(0).cast("long").alias("tile"), F.lit(True).alias("col")).select(*columns)
    if not keys.where(F.col("n") > tile).isEmpty():
        cells = cells.union(_tiles(placed.where(F.col("n") > tile), percent, tile).select(*columns))
    # few bytes take long here, so the partitions are as many as asked for, not as the bytes would have it
    n = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "key", "tile").sortWithinPartitions("key", "tile", "n_shingles").mapInPandas(run, "a long, b long").distinct()


def _tiles(placed: DataFrame, percent: int, tile: int) -> DataFrame:
    """Members of large buckets, a row for each pair of tiles they take part in. Sizes that can be similar lie in one class
    or in neighbouring ones; a class is cut into tiles by hash."""
    ratio = 1.001 * 100 / percent  # a little wide, so that rounding of logarithms parts nothing
    placed = placed.withColumn("cls", F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(ratio)).cast("int"))
    count = lambda rows, name: rows.groupBy("key", "cls").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    of_rows = count(placed.where("row"), "row_tiles").select("key", "row_tiles", F.col("cls").alias("row_cls"), F.explode(F.array(*[F.col("cls") + d for d in (-1, 0, 1)])).alias("cls"))
    meets = of_rows.join(count(placed, "col_tiles"), ["key", "cls"]).withColumnRenamed("cls", "col_cls")
    mine = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles)).cast("int")
    other = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    id_ = F.xxhash64("row_cls", "col_cls", "row_tile", "col_tile").alias("tile")
    names = ["key", "node", "comp", "n_shingles", *SIGNATURE, "row_cls", "col_cls"]
    rows = placed.where("row").withColumnRenamed("cls", "row_cls").join(meets, ["key", "row_cls"]).select(*names, mine("row_tiles").alias("row_tile"), other("col_tiles").alias("col_tile"))
    cols = placed.withColumnRenamed("cls", "col_cls").join(meets, ["key", "col_cls"]).select(*names, mine("col_tiles").alias("col_tile"), other("row_tiles").alias("row_tile"))
    return rows.select("*", id_, F.lit(True).alias("row"), F.lit(False).alias("col")).unionByName(cols.select("*", id_, F.lit(False).alias("row"), F.lit(True).alias("col")))


@plain_columns(None, ("id_col", "text_col"))
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``: documents are linked when 100 times their
    sets' intersection is at least ``percent`` times their union (see the module for nulls, ties and repeats)."""
    ready(docs.sparkSession)
    feats = settled(features(docs, id_col, text_col, k), "features")
    first = feats.groupBy("doc_id").agg(F.min(F.struct("fp", "digest")).alias("p")).select("doc_id", "p.fp", "p.digest")
    reps = first.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "fp")).alias("r")).select("digest", F.col("r.doc_id").alias("node"), F.col("r.fp").alias("fp"))
    chosen = feats.join(reps.select(F.col("node").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi")
    bands = chosen.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").drop("top")
    buckets = settled(bands.distinct().join(hubs, "key"), "buckets")
    nodes = buckets.select("node").distinct()
    sigs = settled(chosen.select(F.col("doc_id").alias("node"), "fp", "n_shingles", *SIGNATURE).join(nodes, "node", "left_semi").dropDuplicates(["node"]), "signatures")
    texts = settled(
        docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text_col).alias("fp"), F.col(text_col).cast("string").alias("text"))
        .join(sigs.select("node", "fp").hint("merge"), ["node", "fp"], "left_semi").dropDuplicates(["node"]).select("node", "text"), "texts",
    )
    star = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = settled(confirmed(star, sigs, texts, k, percent), "links1")
    found = settled(components(links), "components1")
    member = buckets.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = member.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rest = settled(cross_pairs(member.join(mixed, "key", "left_semi").join(sigs.drop("fp"), "node"), percent), "cross")
    rest = rest.join(star, ["a", "b"], "left_anti")  # these were judged already
    more = settled(confirmed(rest, sigs, texts, k, percent), "links2")
    if not more.isEmpty():
        found = components(links.union(more))
    classes = first.where("digest is not null").join(reps.select("digest", "node"), "digest").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    ids = feats.select("doc_id", "n_shingles").join(classes, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = ids.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    without = docs.where(F.col(id_col).isNull())
    return out.union(nameless(without, text_col, k))


def nameless(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """Rows without an id: their set's size, no component, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([W.shingle_count(shingle_words(t), k) for t in b.column(0).cast(pa.binary()).to_pylist()], pa.int64())], names=["n_shingles"])

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "n_shingles long").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))

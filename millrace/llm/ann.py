"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample (the rows with the smallest hashes of their ids,
``SAMPLE_PER_LIST`` for each list).  Every valid row is indexed: the list of its nearest centroid, one byte per subspace
for the direction of what is left, its length, and how far the codewords are off.  A query looks into its ``probes``
nearest lists, and into more where those hold too few vectors; a table of its products with all codewords makes an
asymmetric distance one lookup a subspace.  The best of a block by that measure are scored on the original vectors in
double precision, and so is every other vector that, by the bound on its error, could be nearer than the k-th of them:
in the lists it looks into a query misses nothing, however close together vectors lie.

How many lists are enough is measured on the queries themselves: ``ASKED`` of them (all, if fewer) are compared with every
row, and the lists of their true neighbours counted.  Queries unlike the rows need more lists than rows do.

Equal vectors are one row of the index with the smallest of their ids, so any number of copies leaves room for others.

Lists are split into blocks of bounded size by a hash of the id, so a list that holds a third of all rows is worked on by
many tasks, and the queries that look into a list into parts of bounded size; a task has one block and one part, and only
the k best ids of each query leave it.  There are as many lists as the root of the rows, up to ``MOST_LISTS``: the sample
and the centroids stay within the driver's memory, and beyond the square of that (17 million rows) work grows as rows
times queries, as it does for any fixed number of lists.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do null ids; an id that repeats counts once, with its best score; ties go to the smaller id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import column_at, ready, settled, unsettle

log = logging.getLogger(__name__)

SUBSPACES = 16
CODEWORDS = 256
SAMPLE_PER_LIST = 64
MOST_LISTS = 4096
#: Rows and components of a block, at most.
BLOCK_ROWS = 20_000
BLOCK_NUMBERS = 1 << 22
#: Queries that meet a block of rows in one task.
ASK_ROWS = 8192
#: Queries whose true neighbours tell how many lists to look into.
ASKED = 256
QUERY_BLOCK = 256
#: Query and row pairs that are scored exactly at a time, at most.
PAIRS = 1 << 20


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm by squared distance; empty centres restart at random rows."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float64)
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.bincount(at, weights=x[:, d], minlength=k) / np.maximum(n, 1)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """In double precision, as close vectors differ in the last digits of their products."""
    c = c.astype(np.float64, copy=False)
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096].astype(np.float64, copy=False) @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def _directions(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x - c[at], each of length one (or zero)."""
    out = np.zeros(x.shape, np.float32)
    for i in range(0, len(x), 4096):
        left = x[i : i + 4096] - c[at[i : i + 4096]]
        size = np.sqrt((left * left).sum(axis=1, keepdims=True))
        out[i : i + 4096] = left / np.where(size > 0, size, 1)
    return out


class Index:
    """Centroids and codebooks; vectors are of length one, so the largest product is the largest cosine."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.centres = _kmeans(sample, lists, 10, rng)
        left = _directions(sample, self.centres, _nearest(sample, self.centres))
        d = sample.shape[1]
        self.cuts = [d * m // min(SUBSPACES, d) for m in range(min(SUBSPACES, d) + 1)]
        words = min(CODEWORDS, len(sample))
        self.books = [_kmeans(left[:, a:b], words, 10, rng).astype(np.float32) for a, b in zip(self.cuts, self.cuts[1:])]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, gain, offset and error of vectors of length one.  With centre c, and w the codewords of x, a query
        q has the product q . c + (1 - c . c) / 2 + offset + gain * (q - c) . w with x, but for |q - c| * error at most."""
        at = _nearest(x, self.centres)
        left = x - self.centres[at]
        size = np.sqrt((left * left).sum(axis=1))
        way = _directions(x, self.centres, at)
        codes = np.stack([_nearest(way[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1).astype(np.uint8)
        words = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1).astype(np.float64)
        length = (words * words).sum(axis=1)
        gain = ((left * words).sum(axis=1) / np.where(length > 0, length, 1)).astype(np.float32)
        error = np.sqrt(((left - gain[:, None] * words) ** 2).sum(axis=1)) + 1e-5 * size  # and what single precision rounds
        return at, codes, gain, ((1e-6 - 0.5) * size * size).astype(np.float32), error.astype(np.float32)

    def order(self, q: np.ndarray) -> np.ndarray:
        """What ranks the lists for queries: the larger, the nearer the centre."""
        return q @ self.centres.T - (self.centres * self.centres).sum(axis=1) / 2

    def probes_for(self, asked: np.ndarray, who: np.ndarray, lists: np.ndarray, recall: float) -> int:
        """Lists a query must look into so that ``recall`` of the neighbours (of ``asked[who]``, in ``lists``) lie there."""
        if not len(who):
            return len(self.centres)
        order = np.argsort(-self.order(asked), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(self.centres)), order.shape), axis=1)
        needed = np.sort(rank[who, lists])
        return int(needed[min(len(needed) - 1, int(np.ceil(len(needed) * recall)) - 1)]) + 1

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries, less a centre, with all codewords: queries x subspaces x codewords."""
        q = q.astype(np.float32)
        return np.stack([q[:, a:b] @ book.T for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, with components as double."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(finite)
    return out.where(F.exists("v", lambda x: x != 0))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(good: DataFrame, k: int) -> DataFrame:
    """vec_id, ids, v: a row for each distinct vector (by a 128-bit hash) with its smallest k + 1 ids and the smallest
    of them.  Only ids are grouped, and all but k + 1 of a class stay in the tasks that read them."""
    keyed = good.select("vec_id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    ids = keyed.select("a", "b", "vec_id").distinct().withColumn("r", first).where(F.col("r") <= k + 1)
    ids = ids.groupBy("a", "b").agg(F.min("vec_id").alias("vec_id"), F.collect_list("vec_id").alias("ids"))
    return keyed.join(ids, ["vec_id", "a", "b"]).dropDuplicates(["vec_id", "a", "b"]).select("vec_id", "ids", "v")


def _scaled(column: pd.Series) -> np.ndarray:
    """Vectors as double, each by a power of two, so products stay finite and no digit changes."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """x[i] . y[j], summed in order of components: the same bits wherever a pair stands in a block."""
    out = np.zeros(len(i))
    for d in range(x.shape[1]):
        out += x[i, d] * y[j, d]
    return out


def _block_scores(q: np.ndarray, x: np.ndarray, own: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of all queries with x[cols], a query's own row aside."""
    out = q @ x[cols].T
    out[own[:, cols]] = -np.inf
    return out


def _nearest_ids(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows with the k best distinct ids of each ``who``; ties go to the smaller id."""
    at = np.lexsort((-score, ids, who))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (who[at][1:] != who[at][:-1]) | (ids[at][1:] != ids[at][:-1])
    at = at[new]
    at = at[np.lexsort((ids[at], -score[at], who[at]))]
    starts = np.flatnonzero(np.r_[True, who[at][1:] != who[at][:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)])) < k]


def true_lists(coded: DataFrame, asked: np.ndarray, ids: np.ndarray, kind: type, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``asked``, list) of the vectors that hold the ``k`` nearest ids of each, its own aside: every row is looked
    at, a task keeps k a query, and k a query come to the driver."""
    shared = coded.sparkSession.sparkContext.broadcast((asked, ids))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, own = shared.value
        score = np.full((len(q), k), -np.inf)
        what = np.zeros((len(q), k, 3), np.int64)  # id, list, number of ids
        for f in frames:
            near = q @ _unit(pd.Series([np.frombuffer(b, kind) for b in f["x"]])).T
            row = np.stack([f["vec_id"].to_numpy(), f["list"].to_numpy(), f["ids"].map(len).to_numpy()], axis=1).astype(np.int64)
            near[(own[:, None] == row[None, :, 0]) & (row[:, 2] == 1)[None, :]] = -np.inf
            some = np.flatnonzero((near >= score[:, -1:]).any(axis=0))
            both = np.concatenate([score, near[:, some]], axis=1)
            names = np.concatenate([what, np.broadcast_to(row[some], (len(q), len(some), 3))], axis=1)
            at = np.lexsort((names[:, :, 0], -both), axis=1)[:, :k]
            score, what = np.take_along_axis(both, at, axis=1), np.take_along_axis(names, at[:, :, None], axis=1)
        who, place = np.nonzero(score > -np.inf)
        what = what[who, place]
        yield pd.DataFrame({"who": who, "near": score[who, place], "vec_id": what[:, 0], "list": what[:, 1], "n": what[:, 2]})

    found = coded.select("list", "vec_id", "ids", "x").mapInPandas(best, "who int, near double, vec_id long, list int, n int")
    rank = F.row_number().over(Window.partitionBy("who").orderBy(F.desc("near"), "vec_id"))
    near = found.withColumn("r", rank).where(F.col("r") <= k).select("who", "r", "list", "n").toPandas().sort_values(["who", "r"])
    others = np.maximum(near["n"] - 1, 1)  # of several ids one may be its own
    near = near[others.groupby(near["who"]).cumsum() - others < k]
    return near["who"].to_numpy(), near["list"].to_numpy()


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = 0.98, least_probes: int = 16, refine: int = 250) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` its ``k`` nearest among ``rows`` but itself.

    A query probes as many lists as the true neighbours of a part of the queries need for ``recall`` (``least_probes`` at
    least, and so many that they hold ``k`` others).  The best ``refine`` vectors of each block are scored exactly, with all
    that tie with the last of them, then all that could still be among its ``k`` nearest."""
    spark = ready(rows.sparkSession)
    at = [column_at(rows.columns, c) for c in (id_col, vector_col)]
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).select(F.col(f"c{at[0]}").alias("id"), F.col(f"c{at[1]}").alias("v"))
    at = [column_at(queries.columns, c) for c in (id_col, vector_col)]
    queries = queries.toDF(*[f"c{i}" for i in range(len(queries.columns))]).select(F.col(f"c{at[0]}").alias("id"), F.col(f"c{at[1]}").alias("v"))
    good = valid_vectors(rows, "id", "v")
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], empty)
    good = good.where(F.size("v") == dims["d"])
    asked = valid_vectors(queries, "id", "v").where(F.size("v") == dims["d"])
    kind = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    distinct = settled(classes(good, k).withColumn("v", F.col("v").cast("array<float>" if kind is np.float32 else "array<double>")), "classes")
    n = distinct.count()
    lists = int(np.clip(2 ** round(np.log2(max(1.0, n**0.5))), 1, MOST_LISTS))
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(max(4096, SAMPLE_PER_LIST * lists)).select("vec_id", "v").toPandas()
    units = _unit(sample["v"]).astype(np.float32)
    index = Index(units, min(lists, len(units)))
    lists = len(index.centres)
    shared = spark.sparkContext.broadcast(index)  # bounded by MOST_LISTS and CODEWORDS

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at, codes, gain, offset, error = shared.value.codes(_unit(f["v"]))
            yield pd.DataFrame({"list": at.astype(np.int32), "vec_id": f["vec_id"], "ids": f["ids"], "codes": [c.tobytes() for c in codes], "gain": gain, "offset": offset, "error": error, "x": [np.asarray(v, kind).tobytes() for v in f["v"]]})

    coded = settled(distinct.mapInPandas(code, "list int, vec_id long, ids array<long>, codes binary, gain float, offset float, error float, x binary"), "ivf")
    unsettle(distinct)
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(ASKED).toPandas()
    tried = _unit(some["v"])
    near = true_lists(coded, tried, some["vec_id"].to_numpy(), kind, k) if len(some) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    probes = min(lists, max(least_probes, index.probes_for(tried, *near, recall)))
    held = np.zeros(lists, dtype=np.int64)  # ids in each list
    for r in coded.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r["list"]] = r["n"]
    log.info("%d of %d lists are probed", probes, lists)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            q = _unit(f["v"])
            first = shared.value.order(q)
            near = np.argpartition(-first, probes - 1, axis=1)[:, :probes]
            who, of = np.repeat(np.arange(len(q)), probes), near.ravel()
            few = np.flatnonzero(held[near].sum(axis=1) <= k)  # of which one may be the query
            if len(few):
                order = np.argsort(-first[few], axis=1, kind="stable")
                upto = np.cumsum(held[order], axis=1)
                more = np.arange(lists)[None, :] < np.maximum(probes, (upto <= k).sum(axis=1) + 1)[:, None]
                enough = ~np.isin(who, few)
                who, of = np.concatenate([who[enough], few[np.nonzero(more)[0]]]), np.concatenate([of[enough], order[more]])
            raw = [np.asarray(v, np.float64).tobytes() for v in f["v"]]
            yield pd.DataFrame({"list": of.astype(np.int32), "query_id": f["vec_id"].to_numpy()[who], "q": [raw[i] for i in who]})

    blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // dims["d"]))).cast("int").alias("blocks"))
    placed = coded.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.col("blocks")).cast("int")).drop("blocks", "vec_id")
    asks = settled(asked.mapInPandas(probe, "list int, query_id long, q binary"), "asks")
    parts = asks.groupBy("list").agg(F.ceil(F.count("*") / ASK_ROWS).cast("int").alias("parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = placed.join(parts, "list").withColumn("part", every("parts")).drop("parts")
    asks = asks.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("query_id", "q"), F.col("parts")).cast("int")).drop("parts")
    asks = asks.join(blocks, "list").withColumn("block", every("blocks")).drop("blocks")

    def scan(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(rows) and len(asks):
            codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1)
            x = _scaled(pd.Series([np.frombuffer(b, kind) for b in rows["x"]]))
            y = _scaled(pd.Series([np.frombuffer(b, np.float64) for b in asks["q"]]))
            every, all_y, centre = np.arange(len(x)), np.arange(len(y)), shared.value.centres[rows["list"].iloc[0]]
            q, u = _unit(pd.Series(list(y))), _unit(pd.Series(list(x)))
            gap = q - centre
            far, base = np.sqrt((gap * gap).sum(axis=1)), q @ centre + (1 - centre @ centre) / 2
            gain, offset, error = (rows[c].to_numpy() for c in ("gain", "offset", "error"))
            slack = 1e-15 * x.shape[1] + 1e-14  # of sums in another order
            x_long, y_long = np.sqrt(_products(x, every, x, every)), np.sqrt(_products(y, all_y, y, all_y))
            x, y = np.asfortranarray(x), np.asfortranarray(y)
            sizes = rows["ids"].map(len).to_numpy()
            ids, starts = np.concatenate(rows["ids"].to_list()), np.cumsum(sizes) - sizes
            alone = np.where(sizes == 1, ids[starts], 0)
            who = asks["query_id"].to_numpy()
            for a in range(0, len(q), QUERY_BLOCK):
                t = shared.value.tables(gap[a : a + QUERY_BLOCK])
                near = np.zeros((len(t), len(x)), np.float32)
                for m in range(codes.shape[1]):
                    near += t[:, m, codes[:, m]]
                near *= gain
                near += offset
                own = (who[a : a + QUERY_BLOCK, None] == alone[None, :]) & (sizes == 1)[None, :]
                near[own] = -np.inf
                last = min(max(refine, k), len(x))
                cut = -np.partition(-near, last - 1, axis=1)[:, last - 1]
                cols, kth = np.flatnonzero((near >= cut[:, None]).any(axis=0)), min(k, len(x)) - 1
                score = _block_scores(q[a : a + QUERY_BLOCK], u, own, cols)
                if len(cols) < len(x):
                    best = -np.partition(-score, kth, axis=1)[:, kth] - base[a : a + QUERY_BLOCK] - slack
                    near += (far[a : a + QUERY_BLOCK, None] * error[None, :]).astype(np.float32)
                    could = (near >= best[:, None]).any(axis=0)
                    could[cols] = False
                    more = np.flatnonzero(could)
                    cols, score = np.concatenate([cols, more]), np.concatenate([score, _block_scores(q[a : a + QUERY_BLOCK], u, own, more)], axis=1)
                cut = -np.partition(-score, kth, axis=1)[:, kth] - slack
                for b in range(0, len(near), step := max(1, PAIRS // len(x))):
                    i, j = np.nonzero((score[b : b + step] >= cut[b : b + step, None]) & (score[b : b + step] > -np.inf))
                    i, j = i + a + b, cols[j]
                    exact = _products(y, i, x, j) / (x_long[j] * y_long[i])
                    # each vector for all ids of its class
                    many = sizes[j]
                    at = np.repeat(np.arange(len(j)), many)
                    named = ids[np.repeat(starts[j], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
                    other = named != who[i[at]]
                    at, named = at[other], named[other]
                    best = _nearest_ids(i[at], named, exact[at], k)
                    made.append(pd.DataFrame({"query_id": who[i[at[best]]], "vec_id": named[best], "score": exact[at[best]]}))
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = placed.groupBy("list", "block", "part").cogroup(asks.groupBy("list", "block", "part")).applyInPandas(scan, "query_id long, vec_id long, score double")
    scored = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

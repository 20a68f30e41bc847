"""Two-pass external shuffle into shards.

Pass one scatters the records, texts included, uniformly into buckets that fit in memory, by a seeded 128-bit hash of id,
text and a record's number among those that share both.  Equal records are counted once and expanded again with their
numbers (``_numbered``), so a record that a third of all rows repeat scatters like any others.  Pass two takes a bucket
at a time, puts it in the order of those hashes, which doesn't depend on how it arrived, and permutes it by Fisher-Yates
under a generator seeded for that bucket.  Buckets one after the other are then a uniform shuffle of all records; a
record's rank in it decides its shard (``rows`` law: counts differ by one at most) and its slot there.

The number of records before each bucket is one row a bucket; it travels to the bucket's task as a row among the records.
A worker holds one bucket; ``bucket_bytes`` is for workers of some hundred MB, and larger workers over larger tables are
given larger buckets, so that there are fewer.

Defined results: null ids and texts hash as nulls; repeated rows are rows of their own, scattered one by one; rows that
share id and text are told apart by all their columns, so a retried task makes the same order; extra columns pass through,
clashing ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import BATCH_ROWS, plain_columns, ready

ADDED = ("shard", "slot")


def _whole(docs: DataFrame) -> list[Column]:
    """What tells a record from others: every column that can be hashed, doubles and all; maps as sorted entries."""
    return [F.sort_array(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in docs.schema]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with mr_n: 0, or 0, 1, 2 … over the records that share id and text."""
    none = F.lit(0).cast("long")
    keyed = docs.select("*", F.xxhash64(id_col, text_col).alias("mr_h"))
    again = keyed.groupBy("mr_h").agg(F.count("*").alias("n")).where("n > 1").select("mr_h")
    if again.isEmpty():
        return docs.withColumn("mr_n", none)
    one = keyed.join(again, "mr_h", "left_anti").drop("mr_h").withColumn("mr_n", none)
    # equal records are counted, by the columns themselves: a hash in common is no reason to take two for one
    group = [c.alias(f"g{i}") for i, c in enumerate(_whole(docs))]
    many = keyed.join(again, "mr_h", "left_semi").select("mr_h", *docs.columns, F.xxhash64(*_whole(docs)).alias("w"), *group).groupBy("mr_h", "w", *[f"g{i}" for i in range(len(group))])
    many = many.agg(*[F.first(c).alias(c) for c in docs.columns], F.count("*").alias("n")).select("mr_h", "w", F.pmod("w", F.lit(256)).alias("salt"), *docs.columns, "n")
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), none)
    salts = many.groupBy("mr_h", "salt").agg(F.sum("n").alias("n")).select("mr_h", "salt", before(["mr_h"], "salt").alias("offset"))
    many = many.select("*", before(["mr_h", "salt"], "w").alias("within")).join(salts, ["mr_h", "salt"])
    return one.union(many.select(*docs.columns, F.explode(F.sequence(F.col("offset") + F.col("within"), F.col("offset") + F.col("within") + F.col("n") - 1))))


@plain_columns(ADDED, ("id_col", "text_col"))
def shuffle_into_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 20240229, bucket_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` in shuffled order, with shard (0 to ``shards`` - 1) and slot (from 0 in each shard, without gaps)."""
    ready(docs.sparkSession)
    keep = docs.columns
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 64
    total, rows = docs.agg(F.sum(size), F.count("*")).first()
    if not rows:
        return docs.select(*keep, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    buckets = int(-(-total // bucket_bytes))
    keys = [F.xxhash64(F.lit(seed + lane), id_col, text_col, "mr_n") for lane in (0, 1)]
    keyed = _numbered(docs, id_col, text_col).select(*keep, keys[0].alias("mr_key"), keys[1].alias("mr_more"))
    keyed = keyed.withColumn("mr_bucket", F.pmod(F.xxhash64(F.lit(seed), "mr_more"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("mr_bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("mr_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    none = F.lit(None).cast("long")
    marks = counts.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema], none.alias("mr_key"), none.alias("mr_more"), "mr_bucket", before.alias("mr_before"))
    both = keyed.withColumn("mr_before", none).unionByName(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, offset = [], -1, 0
        for b in batches:
            mark = b.filter(pa.compute.is_valid(b["mr_before"]))
            if mark.num_rows:
                bucket, offset = mark["mr_bucket"][0].as_py(), mark["mr_before"][0].as_py()
                b = b.filter(pa.compute.is_null(b["mr_before"]))
            if b.num_rows:
                held.append(b)
        if not held:
            return
        whole = pa.Table.from_batches(held)
        held.clear()
        whole = whole.combine_chunks()  # rows are taken far faster from one chunk than from hundreds
        order = pa.compute.sort_indices(whole.select(["mr_key", "mr_more"]), sort_keys=[("mr_key", "ascending"), ("mr_more", "ascending")]).to_numpy()
        order = order[np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(order))]  # Fisher-Yates
        rank = offset + np.arange(len(order), dtype=np.int64)
        shard = rank * shards // rows
        slot = rank - -(-shard * rows // shards)
        plain = whole.select(keep)
        for a in range(0, len(order), BATCH_ROWS):
            part = plain.take(pa.array(order[a : a + BATCH_ROWS])).combine_chunks()
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shard[a : a + BATCH_ROWS].astype(np.int32)), pa.array(slot[a : a + BATCH_ROWS])], names=[*keep, *ADDED])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "shard int, slot long"])
    return both.repartitionById(buckets, F.col("mr_bucket")).mapInArrow(run, kinds)


def write_shards(docs: DataFrame, path: str, **how: object) -> None:
    """The shuffled records as Parquet, one folder a shard; files and rows in them lie in slot order."""
    shuffle_into_shards(docs, **how).write.partitionBy("shard").parquet(path)

"""The corpus pipeline: documents in, token ids out, in five stages of the operators in ``millrace.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, lines, minhash, mixing, quality
from millrace.llm._shared import settled, unsettle
from millrace.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of policy v2 go."""
    return quality.filter_documents(docs.select(*COLUMNS), policy="v2")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in a document with a smaller id go; n_chars follows the text. A document that has no line left goes
    too, as a copy made of other documents' lines."""
    kept = lines.drop_repeated_lines(docs.select(*COLUMNS), least=10)
    text = F.col("kept_text")
    left = (F.col("n_dropped") == 0) | (F.trim(text, F.lit(" \t\n\x0b\x0c\r")) != "")
    return kept.where(left).select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays: the one with the smallest id.

    Rows are numbered in order of id (a null one last) and hashes of the text, and compared by number, so rows without an
    id and rows that repeat one take part like all others."""
    numbered = settled(_numbered(docs.select(*COLUMNS)), "numbered")
    judged = minhash.near_duplicates(numbered, id_col="row", k=5, percent=80)
    gone = judged.where("not kept").select(F.col("doc_id").alias("row"))
    return numbered.join(gone, "row", "left_anti").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with row: unique, and in order of doc_id (nulls last), then two hashes of the text. Sorted in ranges, so no
    task has all; the driver's sample for the ranges holds the keys, so texts are none of them."""
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc(), F.xxhash64(F.lit(1), "text").asc()]
    return docs.orderBy(*order).withColumn("row", F.monotonically_increasing_id())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; sources weigh 1, 2, 3 in turn."""
    return mixing.mixed_documents(docs.select(*COLUMNS), weights=(1, 2, 3), most=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    path = tokenizer_path()
    back = bpe.decode(bpe.encode(docs.select(*COLUMNS), path), path)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("encoding", encode)]

#: The mix (hash order, Newton steps) and the encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's table goes once the
    next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            unsettle(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

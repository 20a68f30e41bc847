"""Rule bitmask ledger, with DataFrame functions only.

``ledger`` evaluates every rule once per document and stores the measurements and one long whose bit r says that rule r
failed; ``write_ledger`` keeps them, without the texts, so that later policies measure nothing again.  Policies are masks
over those bits, kept by version: ``apply_policy`` compares bits, and ``ablations`` answers what each rule costs by
counting the distinct bit patterns (at most 2 to the number of rules) once.

Repeated three-word windows are found inside the row: the low half of each window's hash and its place form one long,
an array of which sorts as primitives; places whose hash half has a neighbour are then compared by their words, so the
count is exact.

Defined results: null and empty texts have no words (they fail ``few_words``); null ids and repeated rows are kept as
rows; ties don't matter; extra columns of other names pass through ``ledger``, clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import SPACES, column_at, plain_columns

#: Rules in bit order; a rule is SQL over the measurements that is true where a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 8 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
#: A policy is the set of rules it heeds; versions are never changed, only added.
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": tuple(name for name, _ in RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _beside(sorted_array: Column, of) -> Column:
    """Elements of a sorted array that equal a neighbour in ``of``."""
    return F.filter(sorted_array, lambda v, i: (of(v) == of(F.get(sorted_array, i - 1))) | (of(v) == of(F.get(sorted_array, i + 1))))


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the measurements of the whole text. Each step is a projection of its own, so that an array that a
    lambda looks into is made once."""
    keep = [F.col(c) for c in docs.columns]
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    solid = lambda line: F.trim(line, F.lit(SPACES)) != ""
    d = docs.select(*keep, whole.alias("mr_whole"), F.trim(whole, F.lit(SPACES)).alias("mr_text"))
    d = d.select(
        *keep, F.when(F.col("mr_text") == "", F.array().cast("array<string>")).otherwise(F.split("mr_text", r"[\x20\x09-\x0D]+")).alias("mr_w"),
        F.regexp_count("mr_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.filter(F.split("mr_whole", "\n"), solid).alias("mr_lines"),
    )
    w = F.col("mr_w")
    half = lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), 32).bitwiseOR(i.cast("long"))
    d = d.select(
        *keep, "n_symbols", "mr_w", F.size("mr_w").cast("long").alias("n_words"), F.char_length(F.concat_ws("", "mr_w")).cast("long").alias("word_chars"),
        F.size("mr_lines").cast("long").alias("n_lines"), (F.size("mr_lines") - F.size(F.array_distinct("mr_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.slice(F.transform(w, half), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))).alias("mr_h"),
    )
    told = [*keep, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    place = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    window = lambda v: F.struct(F.concat_ws(" ", F.get(w, place(v)), F.get(w, place(v) + 1), F.get(w, place(v) + 2)).alias("k"), place(v).alias("p"))
    d = d.select(*told, "mr_w", _beside(F.col("mr_h"), lambda v: F.shiftright(v, 32)).alias("mr_c"))
    d = d.select(*told, F.sort_array(F.transform("mr_c", window)).alias("mr_e"))
    d = d.select(*told, F.sort_array(F.transform(_beside(F.col("mr_e"), lambda e: e["k"]), lambda e: e["p"])).alias("mr_p"))
    p = F.col("mr_p")
    covered = F.transform(p, lambda v, i: F.least(F.lit(3), v - F.coalesce(F.get(p, i - 1), v - 3)))
    count = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    # never true, but not deterministic: a filter on measurements then isn't pushed below, where it would put each
    # array's expression into lambdas that run once per element
    barrier = F.monotonically_increasing_id() < 0
    return d.select(*told, F.when(barrier, F.lit(0).cast("long")).otherwise(count).alias("n_repeat_words"))


@plain_columns((*MEASURES, "fail_bits"), ("text_col",))
def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (texts included) with the measurements and ``fail_bits``."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text_col).withColumn("fail_bits", bits)


def write_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ledger of ``docs`` as Parquet, a row for each of theirs: its id, the measurements and ``fail_bits``.
    Returns a scan of it, which ``apply_policy`` and ``ablations`` take like any ledger."""
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = rows.select(F.col(f"c{column_at(names, id_col)}").alias("id"), F.col(f"c{column_at(names, text_col)}").alias("text"))
    kept = ledger(rows).select("id", *MEASURES, "fail_bits").toDF(id_col, *MEASURES, "fail_bits")
    kept.write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.schema(kept.schema).parquet(path)


@plain_columns(("kept",), ("bits_col",))
def apply_policy(rows: DataFrame, policy: str, bits_col: str = "fail_bits") -> DataFrame:
    """A ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col(bits_col).bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept if the rule were left out."""
    m = mask(policy)
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = [(1 << i, name) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(bit).cast("long").alias("bit"), F.lit(name).alias("rule")) for bit, name in rules])).alias("r")
    heeded = F.col("fail_bits").bitwiseAND(F.lit(m))
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return counts.select("fail_bits", "n", each).groupBy("r.rule").agg(
        some(heeded.bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
        some(heeded == F.col("r.bit")).alias("failed_alone"),
        some(heeded.bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
    )


def filter_documents(docs: DataFrame, text_col: str = "text", policy: str = "v2") -> DataFrame:
    """The documents a policy keeps, with just their own columns, whatever their names."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    rows = apply_policy(ledger(docs.toDF(*plain), plain[column_at(names, text_col)]), policy)
    return rows.where("kept").select(*plain).toDF(*names)

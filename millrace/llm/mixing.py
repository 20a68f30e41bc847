"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a token target.  Among all document rates between 0 and ``most`` that meet it, entropy balancing takes
the ones that part least from "every document once" (bounded relative entropy); these are exponentially tilted by size,
``rate = most * e / (most - 1 + e)`` with ``e = exp(lambda * size)``.  The convex dual in lambda has one coordinate a
source and is solved for all sources at once by Newton steps kept inside a bracket; a step is one aggregation over the
histogram of (source, size), made once from the documents, never over documents.

Rates become copies by systematic rounding along the sizes of a source, largest first, and then a correction: what the
rounded tokens are off by is paid in copies of a few sizes, largest first (at most ``PER_OCTAVE`` candidate sizes an octave).
Within a size, the documents that get one copy more are chosen by hash.

A source that holds a third of all rows, or a size that does, is split by a salt of the document's hash before anything
is ranked.

Defined results: a null text has size 0, and documents of size 0 get one copy (no words); a null source is a source, the
last; null ids and repeated rows are rows like others; extra columns pass through, clashing ones are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import WORD, column_at, plain_columns, ready, settled, unsettle

SALTS = 64
#: Sizes in an octave that may pay for what rounding leaves.
PER_OCTAVE = 32
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources in code-point order, null last, take the
    weights in turn and share the total; none takes more than ``most`` times its size, what is over is shared again.

    The water level: with sources in order of cap over weight, all up to some place stop at their cap, and the rest
    share what is left by weight. Prefix sums give the level at every place, so no loop is needed. One row a source."""
    all_rows = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1).cast("int")).cast("double").alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    order = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.sum("source_size").over(all_rows).alias("total"), F.sum("weight").over(all_rows).alias("weights"), F.coalesce(F.sum("cap").over(order), F.lit(0.0)).alias("caps"), F.coalesce(F.sum("weight").over(order), F.lit(0.0)).alias("done"), F.row_number().over(by_level).alias("place"))
    level = (F.col("total") - F.col("caps")) / (F.col("weights") - F.col("done"))
    rows = rows.select("*", level.alias("level"))
    final = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))).over(all_rows)["level"]  # the first place that stays under its cap
    return rows.select("source", "source_size", F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight"))).alias("target"))


def _rate(tilt: Column, most: int) -> Column:
    """The tilted rate; ``tilt`` is lambda times size, kept from overflowing."""
    e = F.exp(F.greatest(F.least(tilt, F.lit(60.0)), F.lit(-60.0)))
    return most * e / (most - 1 + e)


def balance(hist: DataFrame, targets: DataFrame, most: int, steps: int = 100, near: float = 1e-9) -> DataFrame:
    """(source, source_size, target, tilt): lambda of every source; null where the target is out of what rates can
    reach (then all documents are taken ``most`` times). ``hist`` has source, size, n."""
    scale = hist.groupBy("source").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("scale"))
    t = targets.alias("t").join(scale.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "s.scale")
    share = F.try_divide("target", "source_size")
    free = (share < most * (1 - 1e-12)) & (F.col("source_size") > 0)
    start = F.try_divide(F.log(F.try_divide(share * (most - 1), most - share)), F.col("scale"))
    now = settled(t.select("source", "source_size", "target", "scale", F.when(free & (share > 0), start).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("off")), "tilts")
    for _ in range(steps):
        r = _rate(F.col("w.tilt") * F.col("h.size"), most)
        sums = (
            hist.alias("h").join(now.where("tilt is not null").alias("w"), F.col("h.source").eqNullSafe(F.col("w.source"))).groupBy(F.col("w.source").alias("source"))
            .agg(F.sum(F.col("h.n") * F.col("h.size") * r).alias("got"), F.sum(F.col("h.n") * F.col("h.size") * F.col("h.size") * r * (1 - r / most)).alias("slope"))
        )
        j = now.alias("w").join(sums.alias("g"), F.col("w.source").eqNullSafe(F.col("g.source")), "left")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        j = j.select("w.*", "g.got", "g.slope").select("source", "source_size", "target", "scale", "tilt", low.alias("low"), high.alias("high"), (F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))).alias("off"), (F.col("tilt") - F.try_divide(gap, F.col("slope"))).alias("newton"))
        wide = F.try_divide(F.lit(2.0), F.col("scale"))
        inner = (F.col("newton") > F.coalesce("low", F.col("tilt") - wide * 8)) & (F.col("newton") < F.coalesce("high", F.col("tilt") + wide * 8))
        halved = (F.coalesce("low", F.col("high") - wide) + F.coalesce("high", F.col("low") + wide)) / 2
        step = F.when(F.col("off") <= near, F.col("tilt")).when(inner, F.col("newton")).otherwise(halved)
        after = settled(j.select("source", "source_size", "target", "scale", step.alias("tilt"), "low", "high", F.coalesce("off", F.lit(0.0)).alias("off")), "tilts")
        unsettle(now)
        now = after
        if not (now.agg(F.max("off")).first()[0] or 0.0) > near:
            break
    else:  # a bracket halves at least every other step, so this takes sums that lose digits
        warnings.warn(f"the dual is not solved to {near} after {steps} steps; rounding pays what its rates leave", stacklevel=2)
    return now.select("source", "source_size", "target", "tilt")


def copies_by_size(hist: DataFrame, tilts: DataFrame, most: int) -> DataFrame:
    """(source, size, n, rate, total): how many copies the documents of one size in one source make together."""
    j = hist.alias("h").join(tilts.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("t.source_size") == 0, F.lit(1.0)).when(F.col("t.tilt").isNull(), F.when(F.col("t.target") > 0, F.lit(float(most))).otherwise(0.0)).otherwise(_rate(F.col("t.tilt") * F.col("h.size"), most))
    rows = j.select("h.source", "h.size", "h.n", "t.target", rate.alias("rate"))
    along = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", upto.alias("upto")).select("*", F.floor(F.col("upto") + 0.5).alias("end"))
    rows = rows.select("source", "size", "n", "target", "rate", (F.col("end") - F.coalesce(F.lag("end").over(along), F.lit(0))).alias("total"))
    rows = rows.withColumn("total", F.greatest(F.lit(0).cast("long"), F.least(F.col("total"), F.col("n") * most)))
    # what is off, and the sizes that can pay for it: in each octave those with most room to add or to take away
    off = F.sum(F.col("total") * F.col("size")).over(Window.partitionBy("source"))
    rows = rows.select("*", (F.round("target") - off).cast("long").alias("missing"))
    can = F.when(F.col("missing") > 0, F.col("n") * most - F.col("total")).otherwise(F.col("total"))
    room = rows.where("size > 0 and missing <> 0").select("source", "size", "missing", can.alias("can"), F.floor(F.log2("size")).alias("octave")).where("can > 0")
    first = F.row_number().over(Window.partitionBy("source", "octave").orderBy(F.least("can", F.lit(8)).desc(), F.col("size").desc()))
    pick = room.select("*", first.alias("place")).where(F.col("place") <= PER_OCTAVE)
    sized = pick.groupBy("source").agg(F.first("missing").alias("missing"), F.sort_array(F.collect_list(F.struct("size", F.col("can").cast("long").alias("can"))), asc=False).alias("sizes"))  # at most 64 octaves
    none = F.array().cast("array<struct<size:bigint,d:bigint>>")

    def pay(acc: Column, x: Column) -> Column:
        left = acc["left"]
        k = F.least(F.floor(F.abs(left) / x["size"] + F.when(x["size"] == acc["last"], F.lit(0.5)).otherwise(F.lit(0.0))), x["can"])
        d = (F.signum(left).cast("long") * k).cast("long")
        made = F.when(k > 0, F.concat(acc["made"], F.array(F.struct(x["size"].alias("size"), d.alias("d"))))).otherwise(acc["made"])
        return F.struct((left - d * x["size"]).alias("left"), made.alias("made"), acc["last"].alias("last"))

    smallest = F.element_at("sizes", -1)["size"]
    paid = sized.select("source", F.explode(F.aggregate("sizes", F.struct(F.col("missing").alias("left"), none.alias("made"), smallest.alias("last")), pay)["made"]).alias("p")).select("source", "p.size", "p.d")
    out = rows.alias("r").join(paid.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")), "left")
    return out.select("r.source", "r.size", "r.n", "r.rate", (F.col("r.total") + F.coalesce("p.d", F.lit(0))).alias("total"))


@plain_columns(ADDED, ("id_col", "text_col", "source_col"))
def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies (0 to ``most``) and taken (copies times size)."""
    ready(docs.sparkSession)
    keep = docs.columns
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    salt = F.pmod(key, F.lit(SALTS)).cast("int")
    plain = docs.select(*keep, size.alias("size"), F.col(source_col).cast("string").alias("mr_source"), key.alias("mr_key"), salt.alias("mr_salt"))
    parts = settled(plain.groupBy(F.col("mr_source").alias("source"), "size", F.col("mr_salt").alias("salt")).agg(F.count("*").alias("n")), "sizes")
    hist = settled(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    sums = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = settled(source_targets(sums, weights, most), "targets")
    tilts = balance(hist, targets, most)
    totals = copies_by_size(hist, tilts, most).select("source", "size", "n", "rate", F.floor(F.col("total") / F.col("n")).alias("base"), (F.col("total") % F.col("n")).alias("more"))
    # documents that get one copy more, split over the salts in proportion
    a = parts.alias("a").join(totals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
    a = a.select("a.source", "a.size", "a.salt", "a.n", F.col("b.n").alias("all"), "b.rate", "b.base", "b.more")
    along = Window.partitionBy("source", "size").orderBy("salt")
    end = F.floor(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) * F.col("more") / F.col("all") + F.lit(1e-9))
    a = a.select("*", end.alias("end")).select("source", "size", "salt", "rate", "base", (F.col("end") - F.coalesce(F.lag("end").over(along), F.lit(0))).alias("more"))
    plan = settled(a.alias("a").join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select("a.*", "t.source_size", "t.target"), "plan")
    on = F.col("d.mr_source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.mr_salt") == F.col("p.salt"))
    rank = F.row_number().over(Window.partitionBy("mr_source", "size", "mr_salt").orderBy("mr_key"))
    rows = plain.alias("d").join(plan.alias("p"), on).select("d.*", "p.source_size", "p.target", "p.rate", "p.base", "p.more").withColumn("mr_rank", rank)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise((F.col("base") + (F.col("mr_rank") <= F.col("more")).cast("long")).cast("int"))
    rows = rows.withColumn("copies", copies.cast("int"))
    return rows.select(*keep, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with just their own columns."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    at = [plain[column_at(names, c)] for c in (id_col, text_col, source_col)]
    rows = mix_sources(docs.toDF(*plain), *at, weights, most)
    return rows.where("copies > 0").select(*plain, F.explode(F.sequence(F.lit(1), "copies"))).select(*plain).toDF(*names)

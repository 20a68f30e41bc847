"""Quotation linking: conversations ordered by reply, without quotes.

A line's quote level is the number of ``>`` it begins with.  Lines without any are a message's own.  Consecutive lines of
one level are a passage; blank lines part it into paragraphs.  Passages are normalised (quote marks off, white space of
any kind folded, A-Z lowered), hashed and joined to own passages, paragraphs and lines: each points to the latest earlier
message of its conversation that has it as one of these, or else, from ``LEAST_WORDS`` words on, anywhere within a
passage of its own.  Where nothing has a passage its paragraphs are looked up the same way, and then its lines.  Every
lookup is as-of: keys of one hash in one conversation, in order of turn, each carrying the last own one seen, so a line
that thousands of messages share costs their number and no pairs.  A message replies to the message that most lines of
its outermost quotes come from.

Replies make trees. Each message gets its thread (the turn of the tree's root), its depth under it and its place among the
thread's messages with every reply under what it answers, so a conversation in order of (thread, place) is in reply order
and free of quotes.  Places come from the tour of a tree that goes down and up every message once: each step knows the one
before it, and doubling these pointers in rounds ranks a tour of any length without holding it anywhere.  The messages
that answer one message are put in order by ranges, so an answer to one that a third of all answer is no single task's.

Defined results: a null text is an empty one; a null turn comes before all others (quotes of it count in ``n_linked``,
with ``reply_to`` null, which is its turn; it is a thread of its own) and a null conversation is a conversation; quotes
of nothing found leave ``reply_to`` null and ``n_linked`` 0; of messages with one conversation and turn (repeated
rows) each is a row, and what they quote is pooled; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import SPACES, WORD, plain_columns, ready, settled, unsettle

_MARKS = r"^(?:[\x20\x09]*>)+"
#: A quote of fewer words links only to a whole line, paragraph or passage.
LEAST_WORDS = 4
_PRIME, _BASE = 2**127 - 1, 0x5BD1E995_9E3779B9_7F4A7C15_85EBCA6B % (2**127 - 1)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@lru_cache(1 << 16)
def _word(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=15).digest()) + 1


def _heads(words: list[str]) -> list[int]:
    """Hashes of the first 0, 1, 2 … words."""
    return list(accumulate(map(_word, words), lambda h, w: (h * _BASE + w) % _PRIME, initial=0))


def _key(heads: list[int], a: int, b: int) -> dict:
    return {"h": ((heads[b] - heads[a] * pow(_BASE, b - a, _PRIME)) % _PRIME).to_bytes(16), "words": b - a}


def passages(text: str) -> Iterator[tuple[int, list[list[list[str]]]]]:
    """(level, paragraphs of lines of words) of each run of lines; a blank quoted line parts quotes of any level."""
    level, run = 0, [[]]
    for line in text.split("\n"):
        marks = re.match(_MARKS, line)
        words = re.findall(WORD, line[marks.end() if marks else 0 :].translate(_LOWER))
        at = marks[0].count(">") if marks else 0
        if at != level and not (at and level and not words):
            yield level, [p for p in run if p]
            level, run = at, [[]]
        if words:
            run[-1].append(words)
        else:
            run.append([])
    yield level, [p for p in run if p]


def _keys(text: str) -> Iterator[tuple[int, list[dict]]]:
    """(0, the keys of all own passages, paragraphs and lines), and (level, [passage, paragraph, line]) of quoted lines."""
    own = {}
    for level, run in passages(text):
        heads = _heads([w for p in run for line in p for w in line])
        whole, a = _key(heads, 0, len(heads) - 1), 0
        for p in run:
            part, at = _key(heads, a, a + sum(map(len, p))), a
            for line in p:
                keys = [whole, part, _key(heads, at, at + len(line))]
                at += len(line)
                if level:
                    yield level, keys
                else:
                    own |= {k["h"]: k for k in keys}
            a = at
    if own:
        yield 0, list(own.values())


def _windows(text: str, sizes: list[int]) -> Iterator[set[bytes]]:
    """For each size, the hashes of all runs of so many words in each own passage."""
    for level, run in passages(text):
        if not level:
            heads = _heads([w for p in run for line in p for w in line])
            for n in sizes:
                power = pow(_BASE, n, _PRIME)
                yield {((y - x * power) % _PRIME).to_bytes(16) for x, y in zip(heads, heads[n:])}


def _last_own(own: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (conv, turn, h, words) with origin: a struct of the latest earlier turn with the same conv and h in ``own``."""
    both = own.select("conv", "turn", "h", F.lit(None).cast("int").alias("words"), F.lit(True).alias("own")).distinct()
    both = both.unionByName(asked.select("conv", "turn", "h", "words", F.lit(False).alias("own")))
    # a message's own come after what it quotes, so the rows before hold own ones of earlier turns alone
    upto = Window.partitionBy("conv", "h").orderBy(F.asc_nulls_first("turn"), "own").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("origin", F.last(F.when(F.col("own"), F.struct("turn")), ignorenulls=True).over(upto)).where("not own").drop("own")


def _same(a: str, b: str, *names: str) -> Column:
    return F.expr(" and ".join(f"{a}.{n} <=> {b}.{n}" for n in names))


def reply_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv, turn, n_quoted, n_linked, reply_to for every message that quotes something."""
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    quoting = rows.where(F.col("text").rlike(r"(?:\A|\n)[\x20\x09]*>")).select("conv").distinct()
    rows = rows.alias("m").join(quoting.alias("c"), _same("m", "c", "conv"), "left_semi")
    conv, key = rows.schema["conv"], T.StructType([T.StructField("h", T.BinaryType()), T.StructField("words", T.IntegerType())])
    keys_type = pa.list_(pa.struct([("h", pa.binary()), ("words", pa.int32())]))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(i, *x) for i, t in enumerate(b.column("text").to_pylist()) for x in _keys(t)]
            at = pa.array([m[0] for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv").take(at), b.column("turn").take(at), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], keys_type)], ["conv", "turn", "level", "keys"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (t, sizes) in enumerate(zip(b.column("text").to_pylist(), b.column("sizes").to_pylist())):
                for found in _windows(t, sizes):
                    at = pa.array([i] * len(found), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("conv").take(at), b.column("turn").take(at), pa.array(list(found), pa.binary())], ["conv", "turn", "h"])

    turn = T.StructField("turn", T.LongType())
    pieces = settled(rows.mapInArrow(keyed, T.StructType([conv, turn, T.StructField("level", T.IntegerType()), T.StructField("keys", T.ArrayType(key))])), "quotes")
    lines = pieces.where("level > 0").groupBy("conv", "turn", "level", "keys").agg(F.count("*").alias("n"))
    asked = lines.select("conv", "turn", F.explode("keys").alias("key")).select("conv", "turn", "key.h", "key.words").distinct()
    own = pieces.where("level = 0").select("conv", "turn", F.explode("keys.h").alias("h"))
    first = settled(_last_own(own, asked), "whole")
    open_ = first.where((F.col("origin").isNull()) & (F.col("words") >= LEAST_WORDS))
    sizes = open_.groupBy("conv").agg(F.collect_set("words").alias("sizes"))
    inner = rows.alias("m").join(sizes.alias("s"), _same("m", "s", "conv")).select("m.conv", "m.turn", "m.text", "s.sizes")
    inner = inner.mapInArrow(windows, T.StructType([conv, turn, T.StructField("h", T.BinaryType())]))
    found = first.where(F.col("origin").isNotNull()).unionByName(_last_own(inner, open_).where(F.col("origin").isNotNull()))
    each = lines.select("*", F.posexplode("keys").alias("grain", "key"))
    each = each.alias("l").join(found.alias("f"), _same("l", "f", "conv", "turn") & (F.col("l.key.h") == F.col("f.h")), "left")
    seen = each.groupBy("l.conv", "l.turn", "l.level", "l.keys", "l.n").agg(F.min_by("f.origin", F.when(F.col("f.origin").isNotNull(), F.col("l.grain"))).alias("origin"))
    outer = seen.withColumn("outer", F.min("level").over(Window.partitionBy("conv", "turn")))
    votes = outer.groupBy("conv", "turn", "origin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("level") == F.col("outer"), F.col("n")).otherwise(0)).alias("votes"))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct("votes", "n", "origin")))
    return votes.groupBy("conv", "turn").agg(F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"), best["origin"]["turn"].alias("reply_to"))


def _in_order(edges: DataFrame) -> DataFrame:
    """``edges`` (conv, up, turn) with before: the turn that comes before it among those of one conv and up.  Sorted in
    ranges; a range's first row gets it from the last row of the range before, one row a range."""
    order = [F.asc_nulls_first("conv"), F.asc("up"), F.asc("turn")]
    conv = edges.schema["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, opening = TaskContext.get().partitionId(), None, True
        for b in batches:
            if not b.num_rows:
                continue
            convs, ups, turns = (c.to_pylist() for c in b.columns)
            before, first = [], []
            for row in zip(convs, ups, turns):
                before.append(last[2] if last and last[:2] == row[:2] else None)
                first.append(part if opening else None)
                opening, last = False, row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64()), pa.array(first, pa.int32()), pa.nulls(len(turns), pa.int32())], names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], c.type) for x, c in zip(last, b.columns)] + [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([part], pa.int32())], names)

    names = ["conv", "up", "turn", "before", "first", "last"]
    kinds = T.StructType([conv, *(T.StructField(n, T.LongType()) for n in names[1:4]), *(T.StructField(n, T.IntegerType()) for n in names[4:])])
    rows = settled(edges.select("conv", "up", "turn").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kinds), "siblings")
    ends = rows.where("last is not null").select("conv", "up", F.col("turn").alias("end"), "last")
    opens = rows.where("first is not null").select("conv", "up", "turn", "first")
    # ranges may be empty, so the one before is the nearest; both sides have a row a range
    near = opens.alias("o").join(ends.alias("e"), _same("o", "e", "conv", "up") & (F.col("e.last") < F.col("o.first"))).groupBy("o.conv", "o.up", "o.turn").agg(F.max_by("e.end", "e.last").alias("end"))
    out = rows.where("last is null").alias("r").join(near.alias("n"), _same("r", "n", "conv", "up", "turn"), "left")
    return out.select("r.conv", "r.up", "r.turn", F.coalesce("r.before", "n.end").alias("before"))


def threads(links: DataFrame) -> DataFrame:
    """conv, turn, thread, depth, place of every message that replies or is replied to. ``links`` has conv, turn and
    reply_to, a row a message."""
    edges = settled(links.where("reply_to is not null").select("conv", F.col("reply_to").alias("up"), "turn"), "replies")
    if edges.isEmpty():
        return edges.select("conv", "turn", F.col("up").alias("thread"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("place"))
    placed = settled(_in_order(edges), "ordered")
    lasts = placed.groupBy("conv", "up").agg(F.max("turn").alias("low"))  # the answer a message is left by last
    nodes = edges.select("conv", "turn").union(edges.select("conv", F.col("up").alias("turn"))).distinct()
    at = lambda turn, up: F.struct(turn.alias("turn"), F.lit(up).alias("up"))
    # steps (turn, False) go down to a message, (turn, True) up from it; each with the step before it
    down = nodes.alias("n").join(placed.alias("p"), _same("n", "p", "conv", "turn"), "left").select(
        "n.conv", at(F.col("n.turn"), False).alias("step"), F.when(F.col("p.before").isNotNull(), at(F.col("p.before"), True)).when(F.col("p.up").isNotNull(), at(F.col("p.up"), False)).alias("to"))
    up = nodes.alias("n").join(lasts.alias("c"), F.col("n.conv").eqNullSafe(F.col("c.conv")) & (F.col("n.turn") == F.col("c.up")), "left").select(
        "n.conv", at(F.col("n.turn"), True).alias("step"), F.when(F.col("c.low").isNotNull(), at(F.col("c.low"), True)).otherwise(at(F.col("n.turn"), False)).alias("to"))
    one = F.when(F.col("step.up"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    # what a step has counted: itself and all steps back to ``to``, which is the root's first step once ``done``
    now = settled(down.union(up).select("conv", "step", F.coalesce("to", "step").alias("to"), F.when(F.col("to").isNull(), F.lit(0)).otherwise(F.greatest(one, F.lit(0))).cast("long").alias("place"), F.when(F.col("to").isNull(), F.lit(0)).otherwise(one).cast("long").alias("depth"), F.col("to").isNull().alias("done")), "tour")
    while not now.where("not done").isEmpty():
        x, y = now.where("not done").alias("x"), now.alias("y")
        on = F.col("x.conv").eqNullSafe(F.col("y.conv")) & (F.col("x.to") == F.col("y.step"))
        moved = x.join(y, on).select("x.conv", "x.step", "y.to", (F.col("x.place") + F.col("y.place")).alias("place"), (F.col("x.depth") + F.col("y.depth")).alias("depth"), "y.done")
        after = settled(now.where("done").union(moved), "tour")
        unsettle(now)
        now = after
    return now.where("not step.up").select("conv", "step.turn", F.col("to.turn").alias("thread"), "depth", "place")


@plain_columns(None, ("conv_col", "turn_col", "role_col", "text_col"))
def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (own lines only), n_quoted, n_linked, reply_to, thread, depth, place; a conversation in
    order of thread and place is in reply order."""
    ready(messages.sparkSession)
    own = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"), lambda x: ~x.rlike(_MARKS))
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.trim(F.concat_ws("\n", own), F.lit(SPACES)).alias("text"))
    links = settled(reply_links(messages, conv_col, turn_col, text_col), "links")
    on = lambda other: F.col("m.conv_id").eqNullSafe(F.col(f"{other}.conv")) & F.col("m.turn").eqNullSafe(F.col(f"{other}.turn"))
    out = rows.alias("m").join(links.alias("l"), on("l"), "left").join(threads(links).alias("t"), on("t"), "left")
    none = F.lit(0).cast("long")
    return out.select(
        "m.conv_id", "m.turn", "m.role", "m.text", F.coalesce("l.n_quoted", none).alias("n_quoted"), F.coalesce("l.n_linked", none).alias("n_linked"), "l.reply_to",
        F.coalesce("t.thread", "m.turn").alias("thread"), F.coalesce("t.depth", none).alias("depth"), F.coalesce("t.place", none).alias("place"),
    )

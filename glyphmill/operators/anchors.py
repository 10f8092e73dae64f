"""Matching blocks of two sequences of lines, from anchors: lines that stand once on both sides."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import durable

_PAIR = ["a", "b"]


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (ends are kept as small as may be)."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for k, x in enumerate(places):
        n = bisect_left(ends, x)
        before[k] = at[n - 1] if n else -1
        if n == len(ends):
            ends.append(x)
            at.append(k)
        else:
            ends[n], at[n] = x, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, i, j), sorted by a, b and i, those of a longest run in which j grows too. A task holds two numbers for each anchor of one pair."""
    pair, i, j, schema = None, [], [], None

    def done() -> pa.RecordBatch:
        keep = _increasing(j)
        return pa.RecordBatch.from_arrays([pa.array([pair[0]] * len(keep), schema.field("a").type), pa.array([pair[1]] * len(keep), schema.field("b").type), pa.array([i[k] for k in keep], pa.int64()), pa.array([j[k] for k in keep], pa.int64())], names=["a", "b", "i", "j"])

    for batch in batches:
        schema = batch.schema
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "i", "j"))):
            if pair != (a, b):
                if pair:
                    yield done()
                pair, i, j = (a, b), [], []
            i.append(x)
            j.append(y)
    if pair:
        yield done()


def matching_blocks(lines: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """a, b, a_from, b_from, size: blocks of equal lines, in the same order on both sides, for each of pairs(a, b) of documents.

    lines(key, line_no, line), numbered from 1 without gaps.  Lines that stand once in both documents are anchors; of them a longest
    subsequence in the order of both sides counts (a line that was moved is none).  Between two anchors,
    and before the first and behind the last, equal lines that follow the earlier anchor belong to it, and of the rest those before
    the later one to that.  What follows on one diagonal without a gap is one block, so blocks never cross and no line is in two.

    A line between anchors is compared twice at most, so the work grows with the lines of the pairs, not with their product.
    A pair of repeated documents (a, b) counts once; documents without lines have no blocks.
    """
    own = durable(lines.select(F.col(key).alias("doc"), F.col("line_no").cast("long").alias("n"), F.md5("line").alias("h")))
    wanted = durable(pairs.select(*_PAIR).distinct())
    once = own.groupBy("doc", "h").agg(F.min("n").alias("n"), F.count("*").alias("k")).where("k = 1").drop("k")
    side = lambda df, c, n: df.select(F.col("doc").alias(c), "h", F.col("n").alias(n))
    anchors = wanted.join(side(once, "a", "i"), "a").join(side(once, "b", "j"), ["b", "h"]).select("a", "b", "i", "j")
    kinds = {c: wanted.schema[c].dataType.simpleString() for c in _PAIR}
    kept = anchors.repartition(*_PAIR).sortWithinPartitions("a", "b", "i").mapInArrow(_in_order, f"a {kinds['a']}, b {kinds['b']}, i long, j long")
    # The ends of both sides hold as well: what both begin or end with matches without an anchor.
    sizes = own.groupBy("doc").agg(F.max("n").alias("size"))
    size = lambda c: sizes.select(F.col("doc").alias(c), (F.col("size") + 1).alias(f"{c}_end"))
    ends = wanted.join(size("a"), "a").join(size("b"), "b")
    edges = ends.select("a", "b", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")), F.struct(F.col("a_end").alias("i"), F.col("b_end").alias("j")))).alias("e")).select("a", "b", "e.*")
    along = Window.partitionBy(*_PAIR).orderBy("i")
    gaps = durable(kept.unionByName(edges).withColumn("i2", F.lead("i").over(along)).withColumn("j2", F.lead("j").over(along)))
    room = F.least(F.col("i2") - F.col("i"), F.col("j2") - F.col("j")) - 1
    open_ = gaps.where("i2 IS NOT NULL").select(*_PAIR, "i", "j", "i2", "j2", room.alias("room"))
    step = open_.where("room > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "room")))
    both = F.explode(F.array(F.struct(F.lit(True).alias("on"), (F.col("i") + F.col("k")).alias("x"), (F.col("j") + F.col("k")).alias("y")), F.struct(F.lit(False).alias("on"), (F.col("i2") - F.col("k")).alias("x"), (F.col("j2") - F.col("k")).alias("y"))))
    step = step.select(*_PAIR, "i", "j", "room", "k", both.alias("s")).select(*_PAIR, "i", "j", "room", "k", "s.*")
    text = lambda c, n, h: own.select(F.col("doc").alias(c), F.col("n").alias(n), F.col("h").alias(h))
    step = step.join(text("a", "x", "p"), ["a", "x"]).join(text("b", "y", "q"), ["b", "y"])
    first = lambda on: F.coalesce(F.min(F.when((F.col("on") == on) & (F.col("p") != F.col("q")), F.col("k"))), F.max("room") + 1) - 1
    grown = step.groupBy(*_PAIR, "i", "j").agg(first(True).alias("ahead"), first(False).alias("back"), F.max("room").alias("room"))
    grown = grown.select(*_PAIR, "i", "j", "ahead", F.least("back", F.col("room") - F.col("ahead")).alias("back"))
    whole = gaps.join(grown, [*_PAIR, "i", "j"], "left").na.fill(0, ["ahead", "back"])
    ahead = whole.select(*_PAIR, F.when(F.col("i") > 0, F.col("i")).otherwise(1).alias("x"), (F.col("i") + F.col("ahead")).alias("to"), (F.col("i") - F.col("j")).alias("d"))
    ahead = ahead.join(size("a"), "a").where("x < a_end").drop("a_end")
    back = whole.where("back > 0").select(*_PAIR, (F.col("i2") - F.col("back")).alias("x"), (F.col("i2") - 1).alias("to"), (F.col("i2") - F.col("j2")).alias("d"))
    runs = ahead.where("x <= to").unionByName(back)
    line = Window.partitionBy(*_PAIR, "d").orderBy("x")
    runs = runs.withColumn("new", F.coalesce((F.lag("to").over(line) + 1 != F.col("x")).cast("long"), F.lit(1))).withColumn("run", F.sum("new").over(line))
    out = runs.groupBy(*_PAIR, "d", "run").agg(F.min("x").alias("x"), F.max("to").alias("to"))
    return out.select(*_PAIR, F.col("x").alias("a_from"), (F.col("x") - F.col("d")).alias("b_from"), (F.col("to") - F.col("x") + 1).alias("size"))


def drop_matching(lines: DataFrame, pairs: DataFrame, least: int = 5, key: str = "doc_id") -> DataFrame:
    """lines without those of b that stand in a block of `least` lines or more of one of the pairs(a, b)."""
    found = matching_blocks(lines, pairs, key).where(F.col("size") >= least)
    gone = found.select(F.col("b").alias(key), F.explode(F.sequence("b_from", F.col("b_from") + F.col("size") - 1)).alias("line_no")).distinct()
    return lines.join(gone, [key, "line_no"], "left_anti")

"""Layers of ranges: which one shows where, by a sweep over their starts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import durable, hinted

#: Ranges of one key that one sweep takes; a key of more is cut into parts, at places where as many ranges start.
SWEPT = 1_000_000
#: Most parts of a key.
PARTS = 1024
#: Pieces that a task hands on at once.
HANDED = 50_000


def overlay(ranges: DataFrame, key: str, lo: str, hi: str, priority: str, name: str) -> DataFrame:
    """key, lo, hi, name: the ranges [lo, hi) of each key laid over each other, cut into the pieces in which one of them is on top.

    On top is the highest priority, of equal ones the largest name (a whole number); a null priority lies below all others.
    A range may come back in several pieces; pieces of one name that touch are one.  What no range covers has no piece;
    ranges that are empty or have a null border cover nothing.

    Ranges come to a task in the order of their starts and stay on a heap until their end has passed and they would be
    on top, so a range is one row however wide it is, and a task holds only those that are open.  A key of very many ranges
    is cut into parts first, and a range that lies over a cut is one row on each side; pieces that touch at a cut are joined again.
    """
    rows = ranges.select(F.col(key).alias("k"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"), F.col(priority).cast("double").alias("priority"), F.col(name).cast("long").alias("name")).where("lo < hi")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx("lo", [i / PARTS for i in range(1, PARTS)], 10_000).alias("at")).where(F.col("n") > SWEPT)
    every = F.greatest(F.lit(1), F.floor(F.lit(PARTS * SWEPT) / F.col("n"))).cast("int")
    cuts = durable(sizes.select("k", F.array_sort(F.array_distinct(F.filter("at", lambda x, i: (i + 1) % every == 0))).alias("cuts")))
    whole = cuts.isEmpty()
    if whole:
        dealt = rows.withColumn("part", F.lit(0))
    else:
        rows = rows.join(hinted(cuts), rows["k"].eqNullSafe(cuts["k"]), "left").drop(cuts["k"]).withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
        below = lambda x: F.size(F.filter("cuts", lambda c: c <= x))
        dealt = rows.withColumn("part", F.explode(F.sequence(below(F.col("lo")), below(F.col("hi") - 1))))
        edge = lambda i: F.get(F.col("cuts"), i)
        dealt = dealt.withColumn("lo", F.greatest("lo", F.when(F.col("part") > 0, edge(F.col("part") - 1)))).withColumn("hi", F.least("hi", edge(F.col("part")))).drop("cuts")
    pieces = dealt.repartition("k", "part").sortWithinPartitions("k", "part", "lo").mapInArrow(_swept, f"k {ranges.schema[key].dataType.simpleString()}, lo long, hi long, name long")
    if not whole:
        own = Window.partitionBy("k", "name").orderBy("lo")
        new = (F.lag("hi").over(own) != F.col("lo")) | F.lag("hi").over(own).isNull()
        pieces = pieces.withColumn("run", F.sum(new.cast("long")).over(own)).groupBy("k", "name", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return pieces.select(F.col("k").alias(key), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("name").alias(name))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of rows (k, lo, hi, priority, name, part) that are sorted by k, part and lo."""
    kind = None
    out: tuple[list, ...] = ([], [], [], [])
    open_: list[tuple] = []  # on top: the highest priority, then the largest name
    group, at = None, 0

    def show(until: int | None) -> None:
        """What is on top from `at` on, up to a place or until nothing is open."""
        nonlocal at
        while open_ and (until is None or at < until):
            _, _, name, hi = open_[0]
            if hi <= at:
                heapq.heappop(open_)
                continue
            end = hi if until is None else min(hi, until)
            if out[0] and out[3][-1] == name and out[2][-1] == at and out[0][-1] == group[0]:
                out[2][-1] = end
            else:
                for column, x in zip(out, (group[0], at, end, name)):
                    column.append(x)
            at = end

    def handed(keep: int) -> pa.RecordBatch:
        """All pieces but the last `keep`, which may go on."""
        n = len(out[0]) - keep
        some = pa.RecordBatch.from_arrays([pa.array(x[:n], t) for x, t in zip(out, (kind, pa.int64(), pa.int64(), pa.int64()))], names=["k", "lo", "hi", "name"])
        for column in out:
            del column[:n]
        return some

    for batch in batches:
        kind = batch.schema.field("k").type
        for k, part, lo, hi, priority, name in zip(*(batch.column(c).to_pylist() for c in ("k", "part", "lo", "hi", "priority", "name"))):
            if group != (k, part):
                show(None)
                group = (k, part)
            show(lo)
            at = lo
            heapq.heappush(open_, (float("inf") if priority is None else -priority, -name, name, hi))
            if len(out[0]) > HANDED:
                yield handed(1)
    if group is not None:
        show(None)
        yield handed(0)

"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target by weight, at most `most` times its size; what a capped
source leaves is shared again by weight.  A document is taken floor(target / size of
its source) times, and once more if its hash is below its source's threshold.  The
threshold is found without a sort: words are summed by source and the first bits
of the hash, the bucket in which the budget ends is split by the next bits, and so
on (nested thresholds), until the buckets are single hash values.  Sums are taken
in the map tasks, so a hot source costs no more than others, and the result is one
filter.  Each level reads what the one before it has left: the documents of the boundary buckets.

Defined results: a null text has size 0; null is a source of its own (the last);
documents with equal doc_id and text share a hash and so are taken alike.  The
boundary value is included if that brings the source closer to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import WORD, Scratch, checkpointed
from glyphmill.operators.resolve import numbered

#: Levels and bits a level: 5 * 12 = 60 bits of the hash decide.
LEVELS, BITS = 5, 12
#: Tables with a row per source are broadcast up to this many sources, and joined by shuffle beyond; the results agree.
BROADCAST_SOURCES = 20_000


def targets(sizes: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Weights are 1 to `cycle`, repeating, in code point order with null last; sources are numbered range by
    range.  A source is capped while its share of what the capped ones leave is above `most` times its size;
    a round sums both sides over all sources, and the capped ones only grow.
    """
    w = numbered(sizes, [F.asc_nulls_last("source")], "weight").withColumn("weight", (F.col("weight") - 1) % cycle + 1)
    w = checkpointed(w.withColumn("cap", most * F.col("source_size")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    total, rest, weights, capped, before = None, 0, 1, F.lit(False), -1
    while True:
        got = w.agg(F.sum("source_size").alias("t"), F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("cap"))).alias("c"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        total, rest, weights = got["t"] or 0, (got["t"] or 0) - (got["c"] or 0), got["w"] or 1
        if got["n"] == before:
            break
        before, capped = got["n"], wide("cap") * F.lit(weights).cast("decimal(19,0)") < wide("weight") * F.lit(rest).cast("decimal(19,0)")
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * float(rest) / float(weights))
    return w.select("source", "source_size", target.alias("target"))


def _bucket(level: int) -> Column:
    """The hash's bits down to `level`."""
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1))


def thresholds(docs: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """plan with `times` (whole repeats) and `bar` (one more for hashes whose 60 bits are below it)."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = plan.withColumn("times", times).withColumn("left", F.col("target") - F.col("times") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long"))
    hint = F.broadcast if small else (lambda d: d)
    scratch, kept, rows = Scratch(docs.sparkSession), [], docs.where("size > 0").select("source", "h", "size")
    for level in range(LEVELS):
        s = state.select(F.col("source").alias("s"), "left", "prefix")
        on = F.col("source").eqNullSafe(F.col("s")) & (F.col("left") > 0)
        if level:
            on = on & (_bucket(level - 1) == F.col("prefix"))
            # From here on only documents of boundary buckets are read.
            rows = scratch.table(rows.join(hint(s), on, "left_semi"))
            kept.append(rows)
        histogram = rows.join(hint(s), on).groupBy("source", "left", _bucket(level).alias("b")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("b"))
        histogram = histogram.select("source", "left", "b", "size", run.alias("upto"))
        # The bucket in which the budget ends; the last one if rounding lets none.
        cut = histogram.groupBy(F.col("source").alias("s")).agg(
            F.min_by(F.struct("b", "size", "upto"), F.when(F.col("upto") >= F.col("left"), F.col("b"))).alias("c"), F.max_by(F.struct("b", "size", "upto"), "b").alias("d")
        )
        cut = cut.select("s", F.coalesce("c", "d").alias("c"))
        state = state.join(hint(cut), F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "times",
            F.when(F.col("c").isNull(), F.lit(0.0)).otherwise(F.col("left") - (F.col("c.upto") - F.col("c.size"))).alias("left"),
            F.coalesce("c.b", "prefix").alias("prefix"), F.col("c.size").alias("size"),
        )
        state = checkpointed(state)
    scratch.drop(*kept)
    nearer = F.col("size").isNotNull() & (F.col("left") * 2 >= F.col("size"))
    return state.select("source", "source_size", "target", "times", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("bar"))


def _hash() -> Column:
    return F.xxhash64("doc_id", "text")


def _plan(documents: DataFrame, most: int, cycle: int) -> tuple[DataFrame, DataFrame, bool]:
    """A narrow table of the documents, the state of the sources, and whether the latter is small."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = checkpointed(documents.select("doc_id", "source", size.alias("size"), _hash().alias("h")))
    plan = checkpointed(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), most, cycle))
    small = plan.count() <= BROADCAST_SOURCES
    state = thresholds(docs, plan, small).withColumnRenamed("source", "s")
    return docs, F.broadcast(state) if small else state, small


def _copies() -> Column:
    return F.col("times") + (_bucket(LEVELS - 1) < F.col("bar")).cast("long")


def mix(documents: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: a row per row of `documents`."""
    docs, state, _ = _plan(documents, most, cycle)
    return docs.join(state, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken")
    )


def mixed(documents: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """The rows of `documents`, each as often as the mix takes it. Documents without words are taken as often as their source's others."""
    _, state, _ = _plan(documents, most, cycle)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, _hash().alias("h"), F.col("source").alias("own"))
    rows = rows.join(state, F.col("own").eqNullSafe(F.col("s")), "left").withColumn("copies", _copies()).where("copies > 0")
    return rows.select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "row").select("row.*")

"""Sequence-aware removal of repeats; order and legal duplicates elsewhere stay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.lines import each_document


def common_blocks(rows: DataFrame, width: int = 12, least_docs: int = 4, key: str = "doc_id") -> DataFrame:
    """key, line_no of lines in `width`-line shingles that `least_docs` documents or more hold, except in the smallest of them."""
    w = Window.partitionBy(key).orderBy("line_no")
    own = F.array(*[F.lead("line", k).over(w) for k in range(width)])
    shingles = rows.select(key, "line_no", own.alias("s")).where(F.col("s")[width - 1].isNotNull())
    shingles = shingles.select(key, "line_no", F.sha2(F.array_join("s", "\n"), 256).alias("h"))
    holders = shingles.select("h", key).distinct().groupBy("h").agg(F.count("*").alias("docs"), F.min(key).alias("keeper")).where(F.col("docs") >= least_docs)
    hits = shingles.join(holders, "h").where(F.col(key) > F.col("keeper"))
    return hits.select(key, F.explode(F.sequence(F.col("line_no"), F.col("line_no") + width - 1)).alias("line_no")).distinct()


def prefer_macro_twins(rows: DataFrame, rendered: Column, macro: str = r"[@%{]", key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Of neighbours that render alike, the plain one goes where the other has a macro."""
    w = Window.partitionBy(key).orderBy(order)
    has = F.col("line").rlike(macro)
    rows = rows.withColumn("_r", rendered).withColumn("_m", has)
    twin = F.coalesce((F.lag("_r").over(w) == F.col("_r")) & F.lag("_m").over(w), F.lit(False)) | F.coalesce((F.lead("_r").over(w) == F.col("_r")) & F.lead("_m").over(w), F.lit(False))
    return rows.withColumn("_t", twin & ~F.col("_m")).where(~F.col("_t")).drop("_r", "_m", "_t")


def folded(rows: DataFrame, most: int = 120, key: str = "doc_id") -> DataFrame:
    """rows(key, line_no, line) without the second of two equal blocks that follow each other; line_no is gapless.

    Equal lines at a distance of d at most `most` meet by cells of line numbers, so a line has few partners however often it
    stands there.  Runs of pairs of one distance tell where a block of d lines comes twice; of those that begin at one
    line the longest counts, and a document's blocks are taken from its start, each beyond the one before it.
    """
    cell = F.floor(F.col("line_no") / most)
    left = rows.select(key, "line", F.col("line_no").alias("i"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    right = rows.select(key, "line", F.col("line_no").alias("j"), cell.alias("cell"))
    pairs = left.join(right, [key, "line", "cell"]).where((F.col("j") > F.col("i")) & (F.col("j") - F.col("i") <= most)).select(key, "i", (F.col("j") - F.col("i")).alias("d"))
    pairs = pairs.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key, "d").orderBy("i")))
    runs = pairs.groupBy(key, "d", "run").agg(F.min("i").alias("a"), F.max("i").alias("b")).where(F.col("b") - F.col("a") + 1 >= F.col("d"))
    starts = runs.select(key, "d", F.explode(F.sequence(F.col("a"), F.col("b") - F.col("d") + 1)).alias("i"))
    best = starts.groupBy(key, "i").agg(F.max("d").alias("d")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("blocks"))
    zero = F.struct(F.lit(0).cast("long").alias("past"), F.array().cast("array<struct<i:bigint,d:bigint>>").alias("taken"))
    take = lambda acc, x: F.when(x["i"] > acc["past"], F.struct((x["i"] + 2 * x["d"] - 1).alias("past"), F.array_append(acc["taken"], x).alias("taken"))).otherwise(acc)
    taken = best.select(key, F.explode(F.aggregate("blocks", zero, take, lambda acc: acc["taken"])).alias("t"))
    gone = taken.select(key, F.explode(F.sequence(F.col("t.i") + F.col("t.d"), F.col("t.i") + 2 * F.col("t.d") - 1)).alias("line_no"))
    return rows.join(gone, [key, "line_no"], "left_anti")


def drop_earlier_repeats(lines: list[str], least: int = 5) -> list[int]:
    """Places that stay when every longest run of `least` lines or more goes that stood before as a whole, and apart from it."""
    number = {x: k for k, x in enumerate(dict.fromkeys(lines))}
    if len(lines) - len(number) < least:
        # A run of `least` lines that stood before would repeat as many.
        return list(range(len(lines)))
    own = np.array([number[x] for x in lines], np.int64)
    starts: dict[bytes, list[int]] = {}
    keep, i, known = [], 0, 0
    while i < len(own):
        # Places up to i - least may begin a run that ends before i.
        while known <= i - least:
            starts.setdefault(own[known : known + least].tobytes(), []).append(known)
            known += 1
        at = np.array(starts.get(own[i : i + least].tobytes(), ()) if i + least <= len(own) else (), np.int64)
        n = least
        while len(at):
            more = at[(at + n < i) & (i + n < len(own))]
            more = more[own[more + n] == own[i + n]] if len(more) else more
            if not len(more):
                break
            at, n = more, n + 1
        if len(at):
            i += n
        else:
            keep.append(i)
            i += 1
    return keep


def by_document(rows: DataFrame, keep, key: str = "doc_id") -> DataFrame:
    """rows(key, line_no, line) that `keep` (lines to places) leaves in each document."""

    def run(numbers: list[int], lines: list[str]) -> list[tuple[int, str]]:
        return [(numbers[k], lines[k]) for k in keep(lines)]

    return each_document(rows, run, key)


def smallest_period(items: Column) -> Column:
    """The smallest p such that an array repeats its first p items; its length if it doesn't."""
    n = F.size(items)
    fits = lambda p: F.forall(F.sequence(F.lit(0), F.greatest(n - p - 1, F.lit(0))), lambda i: (i + p >= n) | (F.get(items, i) == F.get(items, (i + p).cast("int"))))
    return F.when(n > 0, F.array_min(F.filter(F.sequence(F.lit(1), n), fits))).otherwise(F.lit(0))

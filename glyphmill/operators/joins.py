"""Joins that Spark has no single operator for, as compositions of those it has."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from glyphmill.functions import text as T
from glyphmill.session import BROADCAST_ROWS, durable, hinted


def asof(left: DataFrame, right: DataFrame, key: str, order: str, value: str, strict: bool = False, within: str | None = None) -> DataFrame:
    """left with the `value` of the latest right row of the same key at or before its `order` (before, if strict).

    within: how far back that row may lie, as SQL (`50`, `INTERVAL 1 HOUR`); a farther one gives null, and no earlier one is looked for.
    One shuffle: both sides are united, sorted by key and order, and the last value is carried on.
    """
    a = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, order, F.col(value).alias("_value")).withColumn("_side", F.lit(1 if strict else 0)).withColumn("_right", F.lit(True))
    both = a.withColumn("_right", F.lit(False)).unionByName(b, allowMissingColumns=True)
    seen = F.last(F.when(F.col("_right"), F.struct("_value", F.col(order).alias("_at"))), ignorenulls=True).over(Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_seen", seen)
    near = F.col("_seen._value") if within is None else F.when(F.expr(f"_seen._at + {within}") >= F.col(order), F.col("_seen._value"))
    return found.withColumn(value, near).where(~F.col("_right")).drop("_side", "_value", "_right", "_seen")


def range_lookup(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Inner join of points with the half-open ranges [lo, hi) that hold them, over cells of `width`.

    A range is listed in each cell it touches and a point looks into its own, so the join is an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    listed = ranges.where(F.col(lo) < F.col(hi)).withColumn("_cell", F.explode(F.sequence(cell(lo), cell(hi))))
    return points.withColumn("_cell", cell(at)).join(listed, "_cell").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_cell")


def overlapping(a: DataFrame, b: DataFrame, start: str, length: str, width: int) -> DataFrame:
    """Rows of a whose interval [start, start + length) meets one of b (start, length), by cells of `width`; equal rows all stay."""
    cells = lambda s, n: F.sequence(F.floor(s / width).cast("long"), F.floor((s + n - 1) / width).cast("long"))
    s, n = F.col(start), F.col(length)
    rows = durable(a.where(n > 0).withColumn("_id", F.monotonically_increasing_id()))
    left = rows.select("_id", s.alias("_a"), n.alias("_m"), F.explode(cells(s, n)).alias("_cell"))
    right = b.where(n > 0).select(s.alias("_s"), n.alias("_n")).withColumn("_cell", F.explode(cells(F.col("_s"), F.col("_n"))))
    meets = left.join(right, (left["_cell"] == right["_cell"]) & (F.col("_a") < F.col("_s") + F.col("_n")) & (F.col("_s") < F.col("_a") + F.col("_m")), "left_semi")
    return rows.join(meets.select("_id").distinct(), "_id", "left_semi").drop("_id")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (a patch lies over its base). Reduced in the map tasks first."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


#: Code points that are looked through at once.
CODES_AT_ONCE = 1 << 19


def _marks(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each window of n code points a number below 2 ** bits."""
    mark = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for k in range(n):
        mark *= np.uint64(0x9E3779B97F4A7C15)
        mark += codes[k : len(codes) - n + 1 + k]
    mark ^= mark >> np.uint64(29)
    return (mark * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _may_hold(wanted: DataFrame, count: int, n: int):
    """A function that gives of a text's n-grams (the whole text where it is shorter) those that a table of marks of wanted(gram) allows.

    It leaves out none that is wanted, and one in 64 of the others stays at most, so a join must follow.
    """
    bits = max(16, (64 * count).bit_length())

    @F.pandas_udf(LongType())
    def mark(grams: pd.Series) -> pd.Series:
        return pd.Series(_marks(_codes("".join(grams)), n, bits)[::n].astype(np.int64))

    table = np.zeros(1 << bits, bool)
    # A gram of other than n characters is a whole text, which none of n is equal to.
    table[wanted.where(F.length("gram") == n).select(mark("gram").alias("m")).toArrow()["m"].to_numpy()] = True
    shared = wanted.sparkSession.sparkContext.broadcast(np.packbits(table, bitorder="little"))

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        table, out = shared.value, []
        own = [x or "" for x in texts]
        # All texts of a batch in a row, some at a time; windows that reach over a text's end are left out below.
        row, hits = "".join(own), [np.zeros(0, np.int64)]
        for at in range(0, len(row), CODES_AT_ONCE):
            marks = _marks(_codes(row[at : at + CODES_AT_ONCE + n - 1]), n, bits)
            hits.append(at + np.flatnonzero(table[(marks >> np.uint64(3)).astype(np.int64)] >> (marks & np.uint64(7)).astype(np.uint8) & 1))
        hits = np.concatenate(hits)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        first = np.searchsorted(hits, starts)
        for k, x in enumerate(own):
            at = (hits[first[k] : first[k + 1]] - starts[k]).tolist() if len(x) >= n else []
            out.append([x[i : i + n] for i in at if i + n <= len(x)] if len(x) >= n else [x] if x else [])
        return pd.Series(out, dtype="object")

    return run


def containment(lines: DataFrame, corpus: DataFrame, n: int = 8) -> DataFrame:
    """For each line (line_id, line) the corpus item (item_id, text) that holds most of its n-grams: line_id, item_id, hits, share.

    Grams are counted per pair of line and item before anything else is joined.
    """
    own = durable(lines.select("line_id", T.grams(F.col("line"), n).alias("g")).where(F.size("g") > 0).select("line_id", F.size("g").alias("size"), F.explode("g").alias("gram")))
    # Of the corpus only those grams are kept that a line has, before they are made distinct.
    wanted = durable(own.select("gram").distinct())
    count = wanted.count()
    grams = T.gram_list(F.col("text"), n) if count > BROADCAST_ROWS else _may_hold(wanted, count, n)(F.col("text"))
    theirs = corpus.select("item_id", F.explode_outer(grams).alias("gram")).join(hinted(wanted), "gram", "left_semi").distinct()
    hits = own.join(theirs, "gram").groupBy("line_id", "size", "item_id").agg(F.count("*").alias("hits"))
    best = hits.groupBy("line_id", "size").agg(F.max(F.struct("hits", (-F.col("item_id")).alias("i"))).alias("best"))
    return best.select("line_id", (-F.col("best.i")).alias("item_id"), F.col("best.hits").alias("hits"), (F.col("best.hits") / F.col("size")).alias("share"))


def coverage(expected: DataFrame, covered: DataFrame, on: list[str]) -> DataFrame:
    """Atoms on one side only, with `missing_from`."""
    a = expected.join(covered, on, "left_anti").select(*on, F.lit("covered").alias("missing_from"))
    return a.unionByName(covered.join(expected, on, "left_anti").select(*on, F.lit("expected").alias("missing_from")))

"""Documents as ordered lines, and operators over neighbours in that order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n") -> DataFrame:
    """key, line_no (from 1), line; a null text has no lines."""
    return docs.select(key, F.posexplode(F.split(text, separator)).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def each_document(rows: DataFrame, run, key: str = "doc_id") -> DataFrame:
    """key, line_no, line: what `run` (line numbers and lines of a document, in order, to pairs of both) makes of each document of rows(key, line_no, line).

    Many documents go to Python at once, each as a row of arrays.
    """

    @F.pandas_udf("array<struct<line_no: bigint, line: string>>")
    def each(numbers: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([[{"line_no": n, "line": x} for n, x in run(list(a), list(b))] for a, b in zip(numbers, own)], dtype="object")

    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_own"))
    out = whole.select(key, F.explode(each(F.col("_own.line_no"), F.col("_own.line"))).alias("_r"))
    kind = rows.schema["line_no"].dataType
    return out.select(key, F.col("_r.line_no").cast(kind).alias("line_no"), F.col("_r.line").alias("line"))


def filled(rows: DataFrame) -> DataFrame:
    return rows.where(~T.is_blank(F.col("line")))


def in_order(key: str = "doc_id", order: str = "line_no") -> Window:
    return Window.partitionBy(key).orderBy(order)


def adjacent_duplicates(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows equal to the row before them."""
    return rows.withColumn("before", F.lag("line").over(in_order(key))).where("line = before").drop("before")


def first_occurrences(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each value in the given order. The aggregation starts in the map tasks, so common values cost no more."""
    rest = [c for c in rows.columns if c not in by]
    first = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(*by, "first.*")


def repeated_in_document(rows: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """key, line, times, first_line of lines that a document holds `least` times or more."""
    return rows.groupBy(key, "line").agg(F.count("*").alias("times"), F.min("line_no").alias("first_line")).where(F.col("times") >= least)


def islands(rows: DataFrame, boundary: Column, key: str, order: str, name: str = "group_no") -> DataFrame:
    """rows with a running number that rises at each boundary row."""
    return rows.withColumn(name, F.sum(boundary.cast("long")).over(in_order(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def fence_state(rows: DataFrame, fence: str = "^```", key: str = "doc_id") -> DataFrame:
    """rows with `inside`: whether the line stands between fences (the fences themselves don't)."""
    is_fence = F.col("line").rlike(fence)
    n = F.sum(is_fence.cast("int")).over(in_order(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", ~is_fence & (n % 2 == 1))


def look_ahead(rows: DataFrame, value: Column, name: str, reach: int, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The first non-null value among the next `reach` rows."""
    return rows.withColumn(name, F.first(value, ignorenulls=True).over(in_order(key, order).rowsBetween(1, reach)))


def prefix_variants(rows: DataFrame, least: int = 10, key: str = "doc_id") -> DataFrame:
    """Neighbouring rows of which one begins with the other, of `least` characters or more; pairs don't overlap.

    A run of n such neighbours is consumed pair by pair from its start, which is the parity of the place in the run.
    """
    w = in_order(key)
    a, b = F.col("line"), F.col("next")
    short = F.least(F.length(a), F.length(b))
    rows = rows.withColumn("next", F.lead("line").over(w))
    fits = F.coalesce((short >= least) & (a != b) & (a.startswith(b) | b.startswith(a)), F.lit(False))
    rows = rows.withColumn("fits", fits)
    rows = islands(rows, ~F.lag("fits", 1, False).over(w), key, "line_no", "run")
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy("line_no"))
    return rows.withColumn("place", place).where(F.col("fits") & (F.col("place") % 2 == 1)).select(key, "line_no", "line", "next")


def shared_blocks(rows: DataFrame, width: int = 8, key: str = "doc_id") -> DataFrame:
    """Maximal runs of lines that stand in an earlier document too, found by `width`-line shingles.

    key, keeper (the smallest document with the first shingle of the run), first_line, last_line. A shingle is
    compared with its smallest holder only, so one that many documents share makes no pairs among them.
    """
    w = in_order(key)
    own = F.array(*[F.lead("line", k).over(w) for k in range(width)])
    shingles = rows.select(key, "line_no", own.alias("s")).where(F.col("s")[width - 1].isNotNull())
    shingles = shingles.select(key, "line_no", F.sha2(F.array_join("s", "\n"), 256).alias("h"))
    first = shingles.groupBy("h").agg(F.min(key).alias("keeper"), F.max(key).alias("last")).where("keeper < last").drop("last")
    hits = shingles.join(first, "h").where(F.col(key) > F.col("keeper"))
    run = Window.partitionBy(key, "keeper").orderBy("line_no")
    hits = hits.withColumn("run", F.col("line_no") - F.row_number().over(run))
    return hits.groupBy(key, "keeper", "run").agg(F.min("line_no").alias("first_line"), (F.max("line_no") + width - 1).alias("last_line")).drop("run")


def concatenations(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows that are the concatenation of two or more rows right before them, none of them empty: key, order, text, parts.

    By places in the document's joined text, a row can only begin where one of the rows before it does: one equi-join, whatever the number of parts.
    """
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.length(text)
    # Such a row ends with the one before it.
    ends = F.coalesce((F.lag(text).over(w) != "") & F.col(text).endswith(F.lag(text).over(w)) & (n > F.length(F.lag(text).over(w))), F.lit(False))
    placed = rows.select(key, order, text, F.sum(n).over(so_far).alias("_end"), F.row_number().over(w).alias("_i"), F.sum((n == 0).cast("int")).over(so_far).alias("_blanks"), ends.alias("_ends"))
    a = placed.where(F.col("_ends") & (F.col("_i") > 2)).withColumn("_from", F.col("_end") - 2 * n)
    b = placed.where(n > 0).select(key, (F.col("_end") - n).alias("_from"), F.col("_i").alias("_j"), F.col("_blanks").alias("_before"))
    hits = a.join(b, [key, "_from"]).where((F.col("_j") <= F.col("_i") - 2) & (F.col("_before") == F.col("_blanks")))
    whole = rows.join(hits.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct(order, text)))[text], "").alias("_whole"))
    sound = hits.join(whole, key).where(F.substring(F.col("_whole"), (F.col("_from") + 1).cast("int"), n) == F.col(text))
    return sound.select(key, order, text, (F.col("_i") - F.col("_j")).cast("long").alias("parts"))

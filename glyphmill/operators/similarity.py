"""Similarity of neighbouring texts and of vectors."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glyphmill.session import durable


#: Pieces of one length are held as texts up to this number of characters, and as their hashes beyond.
HELD = 1 << 22


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """Where the longest text that both hold stands in a and in b, and its length: of equal ones the first in a, and there the first in b.

    All pieces of one length of b are a set, in which those of a are looked up. A hit is followed as far as it goes, and a greater length tried.
    """
    at, size, step = 0, 0, 1
    while step:
        k = size + step
        if k <= min(len(a), len(b)):
            held = k * len(b) <= HELD
            pieces = {b[j : j + k] for j in range(len(b) - k + 1)} if held else {hash(b[j : j + k]) for j in range(len(b) - k + 1)}
            for i in range(len(a) - k + 1):
                piece = a[i : i + k]
                # Hashes of different texts may agree.
                if (piece in pieces) if held else (hash(piece) in pieces and piece in b):
                    j = b.index(piece)
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    break
            else:
                k = 0
            if k:
                at, size, step = i, k, 2 * step
                continue
        step //= 2
    return at, b.find(a[at : at + size]), size


def common_length(a: str, b: str) -> int:
    """Length of a longest common subsequence: a row of its table is one number, whose zero bits are where the row rises."""
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for c in a:
        if both := row & places.get(c, 0):
            row = (row + both | row - both) & full
    return len(b) - row.bit_count()


def matched_ratio(a: str, b: str, least: float = 0.0) -> float:
    """SequenceMatcher's ratio without its junk: the longest common text, then the same on both sides of it. A ratio below `least` may come out as 0.

    What matches is a common subsequence, so it has no more characters than both texts share in any order, or than the longest ones of all parts that are still open.
    """
    total = len(a) + len(b)
    if a == b:
        return 1.0
    under = lambda n: 2.0 * n / total < least
    if least and (under(min(len(a), len(b))) or under((Counter(a) & Counter(b)).total())):
        return 0.0
    most = common_length if least else lambda x, y: min(len(x), len(y))
    may = most(a, b)
    same, open_ = 0, [(may, a, b)]
    while open_ and not under(may):
        bound, a, b = open_.pop()
        i, j, k = longest_common(a, b)
        sides = [(most(x, y), x, y) for x, y in ((a[:i], b[:j]), (a[i + k :], b[j + k :])) if k and x and y]
        same, may = same + k, may + k + sum(x[0] for x in sides) - bound
        # The larger part comes first.
        open_ += sorted(sides, key=lambda x: x[0])
    return 0.0 if under(may) else 2.0 * same / total


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Twice the matched characters over all characters; null where a side is. Ratios below `least` may come out as 0."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else matched_ratio(x, y, least) for x, y in zip(a, b)], dtype="float64")

    return run(a, b)


def ratio_at_most(a: Column, b: Column) -> Column:
    """A bound from the lengths: no ratio is above it."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def similar_neighbours(rows: DataFrame, key: str, order: str, text: str, least: float = 0.82) -> DataFrame:
    """key, order, text, next, ratio of neighbours as similar as `least`; the bound by lengths comes before the UDF."""
    rows = rows.withColumn("next", F.lead(text).over(Window.partitionBy(key).orderBy(order)))
    rows = rows.where((F.length(text) > 0) & (F.length("next") > 0) & (ratio_at_most(F.col(text), F.col("next")) >= least))
    return rows.select(key, order, text, "next", ratio(F.col(text), F.col("next"), least).alias("ratio")).where(F.col("ratio") >= least)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def overlap_of_bits(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays of 0 and 1."""
    both = F.aggregate(F.zip_with(a, b, lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    any_ = F.aggregate(F.zip_with(a, b, lambda p, q: F.greatest(p, q)), F.lit(0), lambda s, v: s + v)
    return F.when(any_ > 0, both / any_).otherwise(F.lit(1.0))


def glyph_rows(bits: Column, width: int) -> Column:
    """A picture of 0 and 1, row after row, as one long per row (at most 62 columns); its first column is the highest bit. A rest shorter than a row is left out."""
    row = lambda y: F.aggregate(F.slice(bits, y * width + 1, F.lit(width)), F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long"))
    rows = F.transform(F.sequence(F.lit(1), F.floor(F.size(bits) / width).cast("int")), lambda n: row(n - 1))
    return F.when(F.size(bits) >= width, rows).when(bits.isNotNull(), F.array().cast("array<bigint>"))


def shifted_glyphs(rows: Column, width: int, reach: int = 2) -> Column:
    """An array of a picture moved by up to `reach` rows and columns each way; what is moved in is 0."""
    mask = F.lit((1 << width) - 1).cast("long")

    def row(down: int):
        return lambda _, y: F.coalesce(F.get(rows, y + down), F.lit(0).cast("long"))

    def across(k: int):
        return lambda r: F.shiftleft(r, k).bitwiseAND(mask) if k > 0 else F.shiftright(r, -k) if k < 0 else r

    moves = range(-reach, reach + 1)
    out = [F.transform(F.transform(rows, row(down)), across(k)) for down in moves for k in moves]
    return F.array(*out)


def glyph_overlap(rows: Column, shifted: Column, width: int) -> Column:
    """The greatest share of common dots in all dots of a picture, or of its inversion, and the moved pictures; null where none has a dot."""
    mask = F.lit((1 << width) - 1).cast("long")
    dots = lambda a, b, of: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(of(x, y))), F.lit(0), lambda n, k: n + k)
    share = lambda a, b: F.try_divide(dots(a, b, Column.bitwiseAND), dots(a, b, Column.bitwiseOR))
    best = lambda a: F.array_max(F.transform(shifted, lambda s: share(a, s)))
    return F.greatest(best(rows), best(F.transform(rows, lambda r: r.bitwiseXOR(mask))))


#: Numbers of all means that are broadcast at once.
MEANS_AT_ONCE = 2_000_000


def best_mean(vectors: DataFrame, means: DataFrame, score, key: str, vector: str) -> DataFrame:
    """key, best, score: of means(l, mean) the label whose mean scores highest with a vector, the smallest of equals.

    score(vector, mean) is a column. The means are counted, and broadcast in blocks of bounded size, one after the other; the best of
    all blocks is kept for each vector.
    """
    means = durable(means)
    numbers = means.agg(F.sum(F.size("mean"))).first()[0] or 0
    blocks, parts = max(1, -(-numbers // MEANS_AT_ONCE)), []
    for b in range(blocks):
        own = means.where(F.pmod(F.xxhash64("l"), F.lit(blocks)) == b) if blocks > 1 else means
        listed = own.agg(F.collect_list(F.struct("l", "mean")).alias("means"))
        scored = vectors.join(F.broadcast(listed)).select(key, F.transform("means", lambda m: F.struct(F.round(score(F.col(vector), m["mean"]), 9).alias("score"), (-m["l"]).alias("l"))).alias("s"))
        part = scored.select(key, F.array_max("s").alias("s"))
        parts.append(durable(part) if blocks > 1 else part)
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    if blocks > 1:
        best = best.groupBy(key).agg(F.max("s").alias("s"))
    return best.select(key, (-F.col("s.l")).alias("best"), F.col("s.score").alias("score"))


def nearest_centroid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, best, score: the label whose mean vector is most similar."""
    parts = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(F.col(label).alias("l")).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))
    named = vectors.select(F.struct(key, label).alias("k"), vector)
    return best_mean(named, means, cosine, "k", vector).select("k.*", "best", "score")

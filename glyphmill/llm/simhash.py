"""SimHash near copies: segment bit counts as coordinates, a grid join under their Manhattan distance, exact verification.

A fingerprint has the bits that are set in over half of the hashes of a text's shingles of four words
(XXH64, seed 42; repeats count).  Two fingerprints are linked if they differ in at most four bits.

The embedding cuts 64 bits into 32 segments of two and keeps the number of set bits in each: a point with
coordinates 0, 1 or 2.  A bit that differs moves one coordinate by one, so the Manhattan distance of two points
is a lower bound of the bits in which their fingerprints differ.  Written in unary (0 as 00, 1 as 01, 2 as 11), that
distance is the number of differing bits of the two codes.

The grid: the coordinates are dealt to `axes` axes.  Points at a distance of four at most agree in all axes but
four, so they meet in one of the cells named by the counts in axes - 4 of them.  More axes
make more and emptier cells; how many pays depends on the number of points (`axes_for`) and changes no result.
In a cell the distance of the points bounds the pairs, and what passes is compared exactly.

Equal fingerprints are one point.  A cell only has to tell what is connected: a point that has been reached is not
compared again, so a group of near copies costs about as many comparisons as it has points.  Cells that thousands of
points share are found in a sample of the points (which decides about the layout only): they are cut into blocks that all
hold the cell's first point, and pairs of blocks are compared only if the cell isn't connected after that.
No link is lost, and no task holds more than two blocks of a cell.

Defined results: null and blank texts have the fingerprint 0 and are linked like any other; fewer words than four
are one shingle; repeated rows are linked; rows with a null doc_id get the smallest doc_id of their component, or null;
no documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, mix64, slices
from glyphmill.llm.ngram_join import _hint, merged

WIDTH, SEED, APART = 4, 42, 4
SEGMENTS = 32
#: Shingles whose bits are counted at once.
HASHES = 1 << 16
#: Points of a cell (or block of one) that are compared all with all at once; above, one after the other.
ALL_PAIRS = 64
#: A cell is common if this many points of one SAMPLE-th are in it; BLOCK points of it make a block.
SAMPLE, COMMON, BLOCK = 32, 64, 2048
_EVEN = np.uint64(0x5555555555555555)
_ONE, _ODD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def fingerprint(words: list[bytes]) -> int:
    """The fingerprint of a text's words, as an unsigned 64-bit number."""
    if not words:
        return 0
    text, k = b" ".join(words), min(WIDTH, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(words) - k + 1], ends[k - 1 :]
    n, digest = len(first), xxhash.xxh64_intdigest
    on = np.zeros(64, np.int64)
    for lo in range(0, n, HASHES):
        some = zip(first[lo : lo + HASHES].tolist(), last[lo : lo + HASHES].tolist())
        h = np.fromiter((digest(text[a:b], SEED) for a, b in some), np.uint64, min(HASHES, n - lo))
        on += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * on > n).view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long): a row per row of `documents`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                fps = [fingerprint(t.lower().split()) if t else 0 for t in some.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the segments, each in unary: the differing bits of two codes are their Manhattan distance."""
    half = fp >> _ONE
    return ((fp | half) & _EVEN) | ((fp & half & _EVEN) << _ONE)


def tables_of(axes: int) -> list[np.uint64]:
    """For each choice of axes - APART axes, the bits of the unary code that name a cell."""
    own = [np.uint64(sum(3 << (2 * k) for k in range(a, SEGMENTS, axes))) for a in range(axes)]
    return [np.bitwise_or.reduce(np.array(kept, np.uint64)) for kept in combinations(own, axes - APART)]


def axes_for(points: int) -> int:
    """The number of axes with the least work: rows of cells against pairs of strangers that meet in one (half of all strangers agree in a coordinate)."""
    strangers = lambda n: points * comb(n, APART) * 0.5 ** (SEGMENTS * (n - APART) / n)
    return min(range(6, 13), key=lambda n: comb(n, APART) + strangers(n) / 400)


def in_cells(points: DataFrame, axes: int) -> DataFrame:
    """cell, fp: the points (fp) in all cells that they belong to. Two cells may share a name; that makes no link."""
    tables = tables_of(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            code = unary(fp)
            for k, kept in enumerate(tables):
                with np.errstate(over="ignore"):
                    cell = mix64((code & kept) + np.uint64(k + 1) * _ODD)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), batch.column("fp")], names=["cell", "fp"])

    return points.select("fp").mapInArrow(run, "cell long, fp long")


def _connect(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected among the points of a cell; a point that was reached is not compared again."""
    xs, ys = [], []
    code = unary(fp)
    while len(fp):
        open_ = [(fp[0], code[0])]
        fp, code = fp[1:], code[1:]
        while open_ and len(fp):
            x, own = open_.pop()
            near = np.flatnonzero(np.bitwise_count(code ^ own) <= APART)
            near = near[np.bitwise_count(fp[near] ^ x) <= APART]
            if len(near):
                xs.append(np.full(len(near), x))
                ys.append(fp[near])
                open_ += zip(fp[near], code[near])
                fp, code = np.delete(fp, near), np.delete(code, near)
    return xs, ys


def _pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in the ranges of at most ALL_PAIRS places, many ranges at a time."""
    sizes = ends - starts
    for k in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(int(k), 1)
        own, step = starts[sizes == k], max(1, 500_000 // len(i))
        for a in range(0, len(own), step):
            yield (own[a : a + step, None] + i).ravel(), (own[a : a + step, None] + j).ravel()


def _edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """x, y: links that connect what is connected in each group of rows(keys, fp), sorted by the keys as they come. Rows of the same group that stand in two batches are held."""

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]) if len(fp) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fp))
        few = ends - starts <= ALL_PAIRS
        xs, ys, code = [], [], unary(fp)
        for i, j in _pairs(starts[few], ends[few]):
            on = np.bitwise_count(code[i] ^ code[j]) <= APART
            i, j = i[on], j[on]
            on = np.bitwise_count(fp[i] ^ fp[j]) <= APART
            xs.append(fp[i[on]])
            ys.append(fp[j[on]])
        for lo, hi in zip(starts[~few], ends[~few]):
            own = _connect(fp[lo:hi])
            xs += own[0]
            ys += own[1]
        both = np.stack([np.concatenate([np.zeros(0, np.uint64), *xs]), np.concatenate([np.zeros(0, np.uint64), *ys])]).view(np.int64)
        both = np.unique(np.sort(both, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[1]), pa.array(both[0])], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros((0, len(keys)), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([batch.column(c).to_numpy() for c in keys], axis=1)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            if len(edge):
                yield found(key[: edge[-1] + 1], fp[: edge[-1] + 1])
                key, fp = key[edge[-1] + 1 :].copy(), fp[edge[-1] + 1 :].copy()
        yield found(key, fp)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "x long, y long")


def components(points: DataFrame, scratch: Scratch, axes: int | None = None) -> DataFrame:
    """cls, comp: the points (fp) that are linked with another, with the smallest of their component."""
    axes = axes or axes_for(points.count())
    sampled = in_cells(points.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0), axes).groupBy("cell").agg(F.count("*").alias("k"), F.min("fp").alias("first"))
    common = scratch.table(sampled.where(F.col("k") >= COMMON).select("cell", "first", F.ceil(F.col("k") * SAMPLE / BLOCK).cast("long").alias("blocks")))
    rows = in_cells(points, axes)
    if common.isEmpty():
        return merged(scratch.table(_edges(rows, ["cell"]).distinct()), scratch)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block")
    few = rows.join(_hint(common.select("cell")), "cell", "left_anti")
    many = scratch.table(rows.join(_hint(common), "cell").select("cell", "fp", "blocks", block))
    firsts = common.select("cell", F.col("first").alias("fp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    blocks = many.select("cell", "fp", "block").unionByName(firsts.select("cell", "fp", "block"))
    links = scratch.table(_edges(few, ["cell"]).unionByName(_edges(blocks.distinct(), ["cell", "block"])).distinct())
    labels = merged(links, scratch)
    own = many.join(labels.withColumnRenamed("cls", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    parted = own.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("cell")
    parted = scratch.table(parted)
    if parted.isEmpty():
        return labels
    j = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: (j != F.col("block")) | (F.col("blocks") == 1)))
    met = many.join(_hint(parted), "cell", "left_semi").where("blocks > 1").withColumn("j", j).select("cell", "fp", F.least("block", "j").alias("b1"), F.greatest("block", "j").alias("b2"))
    more = scratch.table(_edges(met, ["cell", "b1", "b2"]).distinct())
    return merged(links.union(more), scratch)


def near_copies(documents: DataFrame, axes: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable by links): a row per row of `documents`."""
    scratch = Scratch(documents.sparkSession)
    rows = scratch.table(fingerprints(documents))
    #: fp, least, k: the distinct fingerprints, with the smallest doc_id and the number of rows.
    points = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")))
    labels = components(points, scratch, axes).withColumnRenamed("cls", "fp")
    # Others are their own component, named by their own row.
    some = scratch.table(points.join(labels, "fp", "left").where("comp is not null or k > 1").select("fp", F.coalesce("comp", "fp").alias("comp"), "least"))
    names = some.join(some.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("fp", "component")
    names = scratch.table(names)
    named = rows.join(_hint(names), "fp", "left")
    own = F.coalesce("component", "doc_id").alias("component_id")
    return scratch.last(named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own))

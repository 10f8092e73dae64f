"""Exact top-k inner products by vector-approximation files.

Every component is turned into floor(scale * x), an integer that a double holds exactly.  The
approximation file is a table of packs of up to PACK vectors: one byte per component, the
number of its cell in a uniform grid over that component's range in the pack, and the grids' ends and
widths.  The exact vectors stand in a table of their own.

Query blocks meet every pack of their length in one job: a task reads a pack and then the
blocks, and never the exact vectors.  The centre of a cell and half its width bound each score from
below and above; what lies below the pack's k-th lower bound is ruled out there, and what
lies below the k-th lower bound of all packs afterwards.  The exact vectors of the rest are
read in the order of their upper bounds: first the 4 k best of each query, then only those
whose bound reaches the k-th exact score, after which the result is certain.

Equal vectors tie in every query, so only the k + 1 smallest ids of a vector can
appear in a result (one of them may be the query's own), each in at most k rows; the rest are set
aside before (rows are counted by vector and id, and the limit of the window runs before its
shuffle as well).

Defined results: vectors that are null or hold null or non-finite components (before or after scaling)
take no part, as do null ids; an empty vector scores 0 with another; vectors of
another length than the query's are no candidates; rows with the query's id are none; repeated
query rows count once.  Scores are compared as integers of any size; one beyond a long is given as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch

CELLS = 256
#: Vectors of a pack and queries of a block; a task holds three tables of PACK x BLOCK doubles.
PACK, BLOCK = 4096, 256
_LONG = 2**63 - 1
FOUND = "q long, query_id long, rid long, vec_id long, lower double, upper double"


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (doubles that are integers) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double") * F.lit(float(scale)))
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & fine)
    # floor() of a double gives a long; rint and a correction stay doubles. Adding 0.0 makes -0.0 equal to 0.0.
    whole = lambda e: F.rint(e) - F.when(F.rint(e) > e, 1.0).otherwise(0.0) + F.lit(0.0)
    return rows.select("vec_id", F.transform(x, whole).alias("v"))


def sortable(score: int) -> bytes:
    """Bytes that compare as integers of any size do."""
    size = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return (0x8000 + size).to_bytes(2, "big") + score.to_bytes(size, "big")
    return (0x7FFF - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def dot(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of doubles that are integers, exactly."""
    if len(a) and np.abs(a).max() * np.abs(b).max() * len(a) < 2**53:
        return int(a @ b)
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))


def packs(exact: DataFrame, size: int) -> DataFrame:
    """n, pack, rids, ids, lo, width, cells (bytes of each): the approximation of exact(rid, vec_id, v)."""

    def run(batches):
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for rid, i, v in zip(batch.column("rid").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("v")):
                own = held.setdefault(len(v), [])
                own.append((rid, i, v.values.to_numpy(zero_copy_only=False)))
                if len(own) == size:
                    yield _pack(held.pop(len(v)))
        for own in held.values():
            yield _pack(own)

    rows = exact.mapInArrow(run, "n int, rids binary, ids binary, lo binary, width binary, cells binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    v = np.stack([r[2] for r in rows]).reshape(len(rows), -1)
    lo = v.min(axis=0)
    with np.errstate(over="ignore"):
        width = np.minimum(v.max(axis=0) / CELLS - lo / CELLS, np.finfo(np.float64).max / 4)
    cells = np.zeros(v.shape, np.uint8)
    on = width > 0
    with np.errstate(over="ignore"):
        cells[:, on] = np.clip(v[:, on] / width[on] - lo[on] / width[on], 0, CELLS - 1).astype(np.uint8)
    parts = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), lo, width, cells]
    return pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["n", "rids", "ids", "lo", "width", "cells"])


def query_blocks(asked: DataFrame, size: int) -> DataFrame:
    """n, ids, rids, lo (bytes of query ids, query numbers, and exact vectors) of asked(q, vec_id, v)."""

    def run(batches):
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for q, i, v in zip(batch.column("q").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("v")):
                own = held.setdefault(len(v), [])
                own.append((q, i, v.values.to_numpy(zero_copy_only=False)))
                if len(own) == size:
                    yield block(held.pop(len(v)))
        for own in held.values():
            yield block(own)

    def block(rows):
        v = np.stack([r[2] for r in rows]).reshape(len(rows), -1)
        parts = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), v]
        return pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["n", "rids", "ids", "lo"])

    return asked.mapInArrow(run, "n int, rids binary, ids binary, lo binary")


class _Pack:
    """A pack's cells as centres and half widths, the latter with what rounding may add."""

    def __init__(self, n: int, rids: bytes, ids: bytes, lo: bytes, width: bytes, cells: bytes):
        self.rids, self.ids = np.frombuffer(rids, np.int64), np.frombuffer(ids, np.int64)
        lo, width = np.frombuffer(lo), np.frombuffer(width)
        cells = np.frombuffer(cells, np.uint8).reshape(len(self.ids), n)
        self.centre = lo + (cells + 0.5) * width
        small = max(1e-12, 1e-15 * n)
        self.half = (1 + small) * width / 2 + small * (np.abs(self.centre) + np.abs(lo))

    def bounds(self, q: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            mid, slack = q @ self.centre.T, np.abs(q) @ self.half.T
            lower, upper = mid - slack, mid + slack
        # Where doubles overflow nothing is known.
        lower[np.isnan(lower)], upper[np.isnan(upper)] = -np.inf, np.inf
        own = query_ids[:, None] == self.ids[None, :]
        lower[own] = upper[own] = -np.inf
        return lower, upper, own


def scan(pairs: DataFrame, k: int) -> DataFrame:
    """FOUND: for each query and pack the vectors that the pack's own bounds don't rule out. pairs: sorted by pack, the pack's row before the blocks."""

    def run(batches):
        pack = None
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                if not row["role"]:
                    pack = _Pack(row["n"], row["rids"], row["ids"], row["lo"], row["width"], row["cells"])
                    continue
                numbers, ids = np.frombuffer(row["rids"], np.int64), np.frombuffer(row["ids"], np.int64)
                lower, upper, own = pack.bounds(np.frombuffer(row["lo"]).reshape(len(ids), row["n"]), ids)
                on = ~own
                if lower.shape[1] > k:
                    on &= upper >= np.partition(lower, lower.shape[1] - k, axis=1)[:, -k][:, None]
                q, v = np.nonzero(on)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[q], ids[q], pack.rids[v], pack.ids[v], lower[q, v], upper[q, v])], names=["q", "query_id", "rid", "vec_id", "lower", "upper"])

    return pairs.mapInArrow(run, FOUND)


def exact_scores(found: DataFrame, exact: DataFrame, asked: DataFrame) -> DataFrame:
    """q, query_id, vec_id, key (sortable), score (nearest long), least (a double not above it) of found(q, query_id, rid, vec_id)."""

    def run(batches):
        for batch in batches:
            scores = [dot(a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)) if len(a) else 0 for a, b in zip(batch.column("v"), batch.column("w"))]
            least = [_below(s) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("q"), batch.column("query_id"), batch.column("vec_id"), pa.array(map(sortable, scores), pa.binary()),
                    pa.array([max(-_LONG - 1, min(_LONG, s)) for s in scores], pa.int64()), pa.array(least, pa.float64()),
                ],
                names=["q", "query_id", "vec_id", "key", "score", "least"],
            )

    rows = found.select("q", "query_id", "rid", "vec_id").join(exact.select("rid", "v"), "rid").join(asked.select("q", F.col("v").alias("w")), "q")
    return rows.select("q", "query_id", "vec_id", "v", "w").mapInArrow(run, "q long, query_id long, vec_id long, key binary, score long, least double")


def _below(score: int) -> float:
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return np.inf if score > 0 else -np.inf


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, scale: int = 256, pack: int = PACK) -> DataFrame:
    """query_id, rank, vec_id, score. `vectors` and `queries`: vec_id, embedding; more columns are left out."""
    scratch = Scratch(vectors.sparkSession)
    keep = scratch.table
    rows = whole_vectors(vectors, scale).groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.select("vec_id", "v", "times", nth.alias("nth")).where(F.col("nth") <= k + 1)
    few = few.select("vec_id", "v", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("row")).drop("row")
    exact = keep(few.withColumn("rid", F.monotonically_increasing_id()))
    asked = keep(whole_vectors(queries, scale).dropDuplicates(["vec_id", "v"]).withColumn("q", F.monotonically_increasing_id()))
    file = keep(packs(exact.select("rid", "vec_id", "v"), pack))
    # A row per pack: their numbers by length.
    file_ids = file.select("row", "n", (F.row_number().over(Window.partitionBy("n").orderBy("row")) - 1).alias("pack"))
    many = file_ids.groupBy("n").agg(F.max("pack").alias("last"))
    blocks = keep(query_blocks(asked.select("q", "vec_id", "v"), block))
    asks = blocks.join(many, "n").select("n", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("pack"), F.lit(1).alias("role"), "rids", "ids", "lo", F.lit(b"").alias("width"), F.lit(b"").alias("cells"))
    own = file.join(file_ids.select("row", "pack"), "row").select("n", "pack", F.lit(0).alias("role"), "rids", "ids", "lo", "width", "cells")
    pairs = own.unionByName(asks).repartition("n", "pack").sortWithinPartitions("n", "pack", "role")
    found = keep(scan(pairs, k))
    by = Window.partitionBy("q")
    bar = found.select("q", "lower", F.row_number().over(by.orderBy(F.desc("lower"))).alias("r")).where(F.col("r") == k).select("q", F.col("lower").alias("bar"))
    left = found.join(bar, "q", "left").where("bar is null or upper >= bar")
    left = keep(left.withColumn("place", F.row_number().over(by.orderBy(F.desc("upper"), "rid"))))
    first = keep(exact_scores(left.where(F.col("place") <= 4 * k), exact, asked))
    bar = first.select("q", "least", F.row_number().over(by.orderBy(F.desc("key"))).alias("r")).where(F.col("r") == k).select("q", F.col("least").alias("bar2"))
    rest = left.where(F.col("place") > 4 * k).join(bar, "q").where("upper >= bar2")
    scored = keep(first.unionByName(exact_scores(rest, exact, asked)))
    scratch.drop(exact, asked, file, blocks, found, left, first)
    ranked = scored.select("query_id", F.row_number().over(by.orderBy(F.desc("key"), "vec_id")).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)

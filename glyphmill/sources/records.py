"""Chains of length-prefixed records in opaque bytes, and where to go on after damage."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Prefix(NamedTuple):
    """What stands before each record: bytes of the length, their order, the least and most that a length may be, and what sizes are rounded up to."""

    width: int = 4
    order: str = "little"
    low: int = 1
    high: int = 1 << 16
    align: int = 1


#: A chain of so many records is sound; so is one that ends with the bytes.
SOUND = 3
#: Bytes of payloads that a task hands on at once.
HANDED = 8 << 20


def _candidates(data: np.ndarray, prefix: Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which a record may begin, its length, and the place behind it."""
    places = max(0, len(data) - prefix.width + 1)
    length = np.zeros(places, np.int64)
    for k in range(prefix.width):
        shift = 8 * (k if prefix.order == "little" else prefix.width - 1 - k)
        length += data[k : k + places].astype(np.int64) << shift
    at = np.flatnonzero((length >= prefix.low) & (length <= prefix.high))
    size = -(-(prefix.width + length[at]) // prefix.align) * prefix.align
    fits = at + size <= len(data)
    return at[fits], length[at][fits], (at + size)[fits]


def _doubled(at: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many records follow each other from each candidate on, and the place behind the last: pointers to the next candidate, doubled until none moves."""
    to = np.searchsorted(at, behind)
    found = (to < len(at)) & (at[np.minimum(to, len(at) - 1)] == behind) if len(at) else np.zeros(0, bool)
    own = np.arange(len(at))
    to, steps = np.where(found, to, own), found.astype(np.int64)
    while True:
        further = to[to]
        if (further == to).all():
            return steps + 1, behind[to]
        steps, to = steps + steps[to], further


def chains(content: bytes, prefix: Prefix = Prefix(), sound: int = SOUND, inner: bool = False) -> Iterator[tuple[str, int, int, int]]:
    """('record', place, size, length) and ('skipped', place, size, 0) that together cover the bytes.

    From where the last chain ended, the first sound chain is looked for; of all that begin inside it the longest is taken (of equal
    ones the first), so a few bytes that happen to look like records don't hide the real ones. With `inner` it is the one whose first record
    ends first: where payloads are texts, which hold no records, a place beside a real one is a record that swallows others, and lands on a long chain at times.
    """
    data = np.frombuffer(content, np.uint8)
    at, length, behind = _candidates(data, prefix)
    steps, end = _doubled(at, behind)
    good = np.flatnonzero((steps >= sound) | (end == len(data)))
    here = 0
    while here < len(data):
        k = int(np.searchsorted(at[good], here))
        if k == len(good):
            yield "skipped", here, len(data) - here, 0
            return
        some = good[k : int(np.searchsorted(at[good], end[good[k]]))]
        best = int(some[np.argmin(behind[some]) if inner else np.argmax(steps[some])])
        if at[best] > here:
            yield "skipped", here, int(at[best]) - here, 0
        for _ in range(int(steps[best])):
            yield "record", int(at[best]), int(behind[best] - at[best]), int(length[best])
            here = int(behind[best])
            best = int(np.searchsorted(at, here))


def record_chains(files: DataFrame, prefix: Prefix = Prefix(), sound: int = SOUND, key: str = "path", inner: bool = False) -> DataFrame:
    """key, kind (record or skipped), place, size, payload of files(key, content): payloads of records, and the bytes between chains as they are.

    Every place counts as a possible record, so damage costs only what it hit: a wrong length ends a chain, and the next sound one goes
    on.  Payloads that hold no records themselves allow `inner` (see chains).  Sizes add up to those of the files.  Null and empty contents have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0

            def handed() -> pa.RecordBatch:
                kinds = (batch.schema.field("key").type, pa.string(), pa.int64(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["key", "kind", "place", "size", "payload"])

            for k, content in zip(batch.column("key"), batch.column("content")):
                data = content.as_py() or b""
                for kind, place, size, length in chains(data, prefix, sound, inner):
                    begins = place + prefix.width if kind == "record" else place
                    payload = data[begins : begins + (length if kind == "record" else size)]
                    for column, x in zip(out, (k.as_py(), kind, place, size, payload)):
                        column.append(x)
                    held += len(payload) + 50
                    if held > HANDED:
                        yield handed()
                        out, held = ([], [], [], [], []), 0
            yield handed()

    kind = files.schema[key].dataType.simpleString()
    out = files.select(F.col(key).alias("key"), F.col("content").cast("binary").alias("content")).mapInArrow(run, f"key {kind}, kind string, place long, size long, payload binary")
    return out.withColumnRenamed("key", key)

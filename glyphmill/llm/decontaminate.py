"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of bounded bytes of a task's documents.  Its words become numbers of the
benchmark's vocabulary; a word that no benchmark item has ends every window, so
only runs of known words that are long enough for a window go into the shard's
text (a lossless reduction).  All windows are searched backward through the ranks
of a wavelet matrix, their occurrences are located by sampled suffix positions, and
the overlapping occurrences are merged into removal spans.  Nothing is shuffled.

The benchmark is handed to the tasks in blocks of about `block_words` words, one block at a time: a
larger benchmark takes more passes, each of which reads the table that the one before it has
written and adds its spans.  The driver and the tasks hold one block, whatever the benchmark's size.

Defined results: a null or empty text has no words, no spans and no items; items
with a null id or without words are left out; repeated rows each get a row; rows of
an item_id that occurs twice are one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Scratch, slices
from glyphmill.llm.fm_index import FMIndex

#: Bytes that end a word: all ASCII but digits and a-z (A-Z are lower-cased before).
_BREAKS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
FOUND = ("n_words long", "spans array<struct<start:long,end:long>>", "items array<string>")
#: Bytes of documents in a shard.
SHARD_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_BREAKS).split() if text else []


class Windows:
    """The windows of a benchmark block: `patterns` (numbers of words), `lengths`, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], width: int = 13):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        rows, owners = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for name, text in items:
            # 0 is the index's end of text and 1 parts the runs.
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)], np.int32)
            if len(ids) >= width:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, width))
            elif len(ids):
                rows.append(np.pad(ids, (0, width - len(ids)))[None, :])
            else:
                continue
            owners.append(np.full(len(rows[-1]), number[name]))
        self.patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.shortest = int(self.lengths.min(initial=width)) if len(self.patterns) else 0
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], axis=1), axis=0)
        self.item = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text of a shard: number of words, merged spans of words, items with occurring windows."""
        counts, runs, at = [], [], []
        for d, text in enumerate(texts):
            words = words_of(text)
            counts.append(len(words))
            if not self.shortest or not words:
                continue
            get = self.vocabulary.get
            ids = np.array([get(w, 0) for w in words], np.int64)
            known = np.concatenate([[False], ids > 0, [False]])
            edge = np.flatnonzero(known[1:] != known[:-1])
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a >= self.shortest:
                    runs.append(np.append(ids[a:b], 1))
                    at.append((d, a))
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        if runs:
            self._hits(runs, at, spans, items)
        for d, n in enumerate(counts):
            yield n, spans.get(d, []), [self.names[i] for i in sorted(items.get(d, ()))]

    def _hits(self, runs, at, spans, items) -> None:
        text = np.concatenate(runs)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        index = FMIndex(text)
        lo, hi = index.ranges(self.patterns, self.lengths)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        place = index.locate(rows)
        # Windows that overlap or touch become one span; no window crosses the mark after a run.
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + self.lengths[which], -1)
        hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        ends = np.flatnonzero(hit[1:] != hit[:-1])
        for a, b in zip(ends[::2], ends[1::2]):
            r = int(np.searchsorted(starts, a, "right")) - 1
            d, offset = at[r]
            spans.setdefault(d, []).append((int(a - starts[r] + offset), int(b - starts[r] + offset)))
        docs = np.array([d for d, _ in at])[np.searchsorted(starts, place, "right") - 1]
        for d, w in np.unique(np.stack([docs, which]), axis=1).T:
            items.setdefault(int(d), set()).update(self.item[self.first[w] : self.first[w + 1]].tolist())


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items, a bounded block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // (4 * block_words) + 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r["item_id"], r["text"]) for r in rows.collect()]


def find_spans(documents: DataFrame, benchmark: DataFrame, width: int = 13, block_words: int = 500_000) -> DataFrame:
    """row (struct of the document's columns), n_words, spans (start and end word), items."""
    df = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    for c in FOUND:
        name, kind = c.split(" ", 1)
        df = df.withColumn(name, F.lit(None).cast(kind))
    schema, scratch, before = T.StructType(df.schema.fields), Scratch(documents.sparkSession), None
    for k, items in enumerate(benchmark_blocks(benchmark, block_words)):
        if k:
            df, old = scratch.table(df), before
            before = df
            if old is not None:
                scratch.drop(old)
        df = df.mapInArrow(_searcher(Windows(items, width)), schema)
    return df.select("row", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _searcher(windows: Windows):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, whole.column("row").field("text"), SHARD_BYTES):
                found = list(windows.search(batch.column("row").field("text").to_pylist()))
                old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                spans = [merge_spans([(s["start"], s["end"]) for s in old or []] + new) for old, (_, new, _) in zip(old_spans, found)]
                items = [sorted({*(old or []), *new}) for old, (_, _, new) in zip(old_items, found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), pa.array(items, pa.list_(pa.string())),
                    ],
                    names=["row", "n_words", "spans", "items"],
                )

    return run


def judged(found: DataFrame) -> DataFrame:
    """found with n_hit and contaminated (a hit, and a twentieth of the words or more)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long"))).withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` that aren't contaminated, unchanged."""
    return judged(find_spans(documents, benchmark)).where(~F.col("contaminated")).select("row.*")

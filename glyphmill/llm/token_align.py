"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same byte, and how often each pair of ids does so.

A text is encoded by both tokenizers in the task that reads it.  Byte offsets at which tokens of both end cut
it into groups; the two tokens that end there are linked.  The links of a slice of documents are cut into
stripes by the id of side B (id modulo the number of stripes, so frequent ids, which have small
numbers, are dealt evenly) and written once.

Counting: the pairs of a stripe, summed in each task first, meet in one task, which adds them into a dense
block of counts (ids of the stripe x ids of side A) by np.add.at.  Row maxima give the best count
of each B id.  A block is as large as the vocabularies make it, whatever the size of the corpus.
Scoring: the stripe's counts and best flags are joined with its links where they lie; a stripe of many links is dealt
over several tasks, each of which gets the stripe's counts.  What is added up by document in a task is
shuffled once more by document.  Nothing is collected.

Defined results: null and empty texts, and texts whose tokens don't give back the blank and the text byte by byte
(U+2581 in a text, for example), have no tokens: zeros and ''.  Each row is a document, also with repeated or null
doc_ids; no documents give no rows; other columns are not looked at.  A vocabulary with a token of no bytes is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, slices

#: Where the files of the vocabularies are; only the driver reads them.
FOLDER = "/opt/tokenizers"
#: B ids of a stripe.
IDS = 128
#: Documents of one slice.
DOCS = 1 << 16
#: Bytes of link codes of one stripe that one task scores.
DEAL_BYTES = 32 << 20
# The pattern that byte-level BPE cuts texts by, and the bytes that stand for themselves in its entries.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Side(NamedTuple):
    """One tokenizer: ids of texts, and the bytes of each id."""

    encode: Callable[[list[str]], list[Sequence[int]]]
    tokens: list[bytes]
    #: Whether the tokens of a text are pieces cut out of its bytes, whatever the text.
    exact: bool = False


def _bytes_of_entry() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(others)}


@cache
def byte_bpe(file: bytes) -> Side:
    """A byte-level BPE (a tokenizer's JSON). Texts get a blank in front."""
    model = json.loads(file)["model"]
    by_char = _bytes_of_entry()
    size = 1 + max(model["vocab"].values())
    tokens, special = [b"?"] * size, {x["content"] for x in json.loads(file).get("added_tokens", [])}
    for entry, k in model["vocab"].items():
        tokens[k] = entry.encode() if entry in special else bytes(by_char[c] for c in entry)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made == list(range(256, 256 + len(made))):
        # The order of the merges is that of the ids, so ids are ranks.
        import tiktoken

        ranks = {tokens[k]: k for e, k in model["vocab"].items() if e not in special}
        fast = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], tokens, True)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(file.decode())
    plain.encode_special_tokens = True
    return Side(lambda texts: [e.ids for e in plain.encode_batch([" " + t for t in texts], add_special_tokens=False)], tokens)


@cache
def pieces(file: bytes) -> Side:
    """A model of pieces, which puts the blank itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=file)
    tokens = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens)


class Aligner:
    """What a task needs of both sides: lengths of tokens, and how ids are written in a document's groups."""

    def __init__(self, a: Side, b: Side):
        if not all(a.tokens) or not all(b.tokens):
            raise ValueError("a token has no bytes")
        self.a, self.b = a, b
        self.sizes = [np.array([len(t) for t in side.tokens], np.int64) for side in (a, b)]
        self.most = max(len(a.tokens), len(b.tokens))
        self.written = [str(k) + end for end in ",|;" for k in range(self.most)]

    def align(self, text: str, a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """Numbers of tokens and groups, the groups' digest, and the ids of both sides of each link."""
        none, wanted = np.zeros(0, np.int64), b" " + text.encode()
        if not text or b"".join(map(self.b.tokens.__getitem__, b)) != wanted:
            return 0, 0, 0, "", none, none
        a, b = np.asarray(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # Pieces that are cut out of a text and have its length are the text.
        if not len(a) or a_ends[-1] != len(wanted) or not self.a.exact and b"".join(map(self.a.tokens.__getitem__, a.tolist())) != wanted:
            return 0, 0, 0, "", none, none
        ends = np.zeros(len(wanted) + 1, bool)
        ends[a_ends] = True
        b_last = np.flatnonzero(ends[b_ends])
        a_last = np.searchsorted(a_ends, b_ends[b_last])
        # A token's text with the sign that follows: a comma in a group, else the one that ends its side. Tokens stand behind those of the groups before.
        order = np.zeros(len(a) + len(b), np.int64)
        for ids, last, before, k in ((a, a_last, np.concatenate([[0], b_last + 1]), 1), (b, b_last, np.append(a_last + 1, 0), 2)):
            new = np.zeros(len(ids), np.int64)
            new[last] = 1
            order[np.arange(len(ids)) + before[np.cumsum(new) - new]] = ids + k * self.most * new
        said = "".join(itemgetter(*order.tolist())(self.written))[:-1]
        return len(a), len(b), len(b_last), hashlib.sha256(said.encode()).hexdigest(), a[a_last], b[b_last]


@cache
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(byte_bpe(a), pieces(b))


class Shape(NamedTuple):
    """How links are cut: the number of stripes, and the bits of an A id in a link's code (row in the stripe, A id)."""

    stripes: int
    bits: int


TOKENS = "row long, stripe int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, docs binary, codes binary, times binary"


def tokens(documents: DataFrame, a: bytes, b: bytes, shape: Shape) -> DataFrame:
    """Rows of two kinds: each document's numbers (stripe -1), and for each slice of documents and stripe its links: place of the document behind `row`, code, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        schema = pa.schema([("row", pa.int64()), ("stripe", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((c, pa.binary()) for c in ("docs", "codes", "times"))])

        def rows(**cols) -> pa.RecordBatch:
            n = len(cols["row"])
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

        for batch in batches:
            for slice_ in slices(batch):
                for lo in range(0, len(slice_), DOCS):
                    some = slice_.slice(lo, DOCS)
                    texts = [t or "" for t in some.column("text").to_pylist()]
                    done = [aligner.align(*x) for x in zip(texts, aligner.a.encode(texts), aligner.b.encode(texts))]
                    row, n = some.column("row"), [[x[k] for x in done] for k in range(4)]
                    yield rows(row=row, stripe=np.full(len(done), -1), doc_id=some.column("doc_id"), n_a=n[0], n_b=n[1], n_groups=n[2], n_links=n[2], groups_sha256=n[3])
                    ids = [np.concatenate([x[k] for x in done]) for k in (4, 5)]
                    doc = np.repeat(np.arange(len(done)), n[2])
                    stripe, line = ids[1] % shape.stripes, ids[1] // shape.stripes
                    key, times = np.unique((((stripe * DOCS + doc) * IDS + line) << shape.bits) | ids[0], return_counts=True)
                    code, key = (key & ((IDS << shape.bits) - 1)).astype(np.uint32), key // (IDS << shape.bits)
                    doc, stripe = (key % DOCS).astype(np.uint16), key // DOCS
                    edge = np.concatenate([np.flatnonzero(np.diff(stripe, prepend=-1)), [len(stripe)]])
                    own = [[x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])] for x in (doc, code, times.astype(np.uint32))]
                    yield rows(row=np.full(len(edge) - 1, row[0].as_py()), stripe=stripe[edge[:-1]].astype(np.int32), docs=own[0], codes=own[1], times=own[2])

    source = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, TOKENS)


def _summed(links: DataFrame) -> DataFrame:
    """stripe, codes, n: what a task has of each stripe, as far as it reads at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list] = {}
            for stripe, codes, times in zip(batch.column("stripe").to_pylist(), batch.column("codes").to_pylist(), batch.column("times").to_pylist()):
                held.setdefault(stripe, []).append((np.frombuffer(codes, np.uint32), np.frombuffer(times, np.uint32)))
            out = []
            for stripe, some in held.items():
                codes, of = np.unique(np.concatenate([c for c, _ in some]), return_inverse=True)
                out.append((stripe, codes.tobytes(), np.bincount(of, np.concatenate([t for _, t in some])).astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["stripe", "codes", "n"])

    return links.select("stripe", "codes", "times").mapInArrow(run, "stripe int, codes binary, n binary")


def counts(links: DataFrame, shape: Shape) -> DataFrame:
    """stripe, codes, n, best: a row for each stripe; best tells the codes whose count is the highest of their B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, seen = np.zeros(IDS << shape.bits, np.int64), None, []

        def done() -> pa.RecordBatch:
            codes = np.unique(np.concatenate(seen))
            n, line = block[codes], codes >> np.uint32(shape.bits)
            first = np.flatnonzero(np.diff(line.astype(np.int64), prepend=-1))
            best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n)))
            block[codes] = 0
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (codes, n, best))], names=["stripe", "codes", "n", "best"])

        for batch in batches:
            for stripe, codes, n in zip(batch.column("stripe").to_pylist(), batch.column("codes").to_pylist(), batch.column("n").to_pylist()):
                if at is not None and stripe != at:
                    yield done()
                    seen = []
                at = stripe
                seen.append(np.frombuffer(codes, np.uint32))
                np.add.at(block, seen[-1], np.frombuffer(n, np.int64))
                if sum(map(len, seen)) > 2 * len(block):
                    seen = [np.unique(np.concatenate(seen))]
        if at is not None:
            yield done()

    return _summed(links).repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, "stripe int, codes binary, n binary, best binary")


def scores(links: DataFrame, counted: DataFrame, deals: DataFrame, shape: Shape) -> DataFrame:
    """row, n_best, count_sum: of each document, what the links of a stripe add. `deals` (stripe, deals) tells over how many tasks a stripe is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, flags, filled = np.zeros(IDS << shape.bits, np.int64), np.zeros(IDS << shape.bits, bool), np.zeros(0, np.uint32)
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            kinds, rows = batch.column("kind").to_pylist(), batch.column("row").to_pylist()
            for kind, row, x, codes, y in zip(kinds, rows, *(batch.column(c).to_pylist() for c in ("x", "codes", "y"))):
                codes = np.frombuffer(codes, np.uint32)
                if not kind:
                    block[filled], flags[filled] = 0, False
                    block[codes], flags[codes], filled = np.frombuffer(x, np.int64), np.frombuffer(y, bool), codes
                    continue
                doc, times = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint32).astype(np.int64)
                starts = np.flatnonzero(np.diff(doc.astype(np.int64), prepend=-1))
                for column, values in zip(out, (row + doc[starts].astype(np.int64), np.add.reduceat(times * flags[codes], starts), np.add.reduceat(times * block[codes], starts))):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["row", "n_best", "count_sum"])

    tables = counted.join(deals, "stripe").select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), F.col("n").alias("x"), "codes", F.col("best").alias("y"))
    dealt = links.join(deals, "stripe").select("stripe", F.pmod(F.xxhash64("row"), F.col("deals")).alias("deal"), F.lit(1).alias("kind"), "row", F.col("docs").alias("x"), "codes", F.col("times").alias("y"))
    rows = tables.unionByName(dealt).repartition("stripe", "deal").sortWithinPartitions("stripe", "deal", "kind")
    return rows.mapInArrow(run, "row long, n_best long, count_sum long")


def align(documents: DataFrame, folder: str = FOLDER, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per row of `documents`."""
    a_file, b_file = (open(f"{folder}/{name}", "rb").read() for name in (a, b))
    size_a, size_b = len(byte_bpe(a_file).tokens), len(pieces(b_file).tokens)
    shape = Shape(-(-size_b // IDS), int(size_a - 1).bit_length())
    if (IDS << shape.bits) > 1 << 32:
        raise ValueError("side A has too many ids for a block")
    scratch = Scratch(documents.sparkSession)
    rows = scratch.table(tokens(documents, a_file, b_file, shape))
    links = rows.where("stripe >= 0")
    counted = scratch.table(counts(links, shape))
    deals = scratch.table(links.groupBy("stripe").agg(F.ceil(F.sum(F.length("codes")) / DEAL_BYTES).cast("long").alias("deals")))
    summed = scores(links, counted, deals, shape).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = rows.where("stripe < 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = own.join(summed, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return scratch.last(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))

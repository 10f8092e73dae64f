"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Sets are the distinct shingles of whole texts, as 64-bit hashes.  A `Rule` gives the words a
shingle and the similarity wanted.  Two sets of at least that similarity, of sizes a and b,
differ in at most (a + b) / 19 elements for nine tenths, (a + b) / 9 for four fifths: the slack.

Sizes fall into bands.  In a band the hash range is cut into a fixed number of parts, more
than the slack of its largest set, so linked sets agree in whole parts.  A tile is the sets of
a band that agree in one part.  A set of slack d makes tiles of d + 1 parts only: those with
most elements, ties broken by the hash of the part's content.  No link is lost: of the
parts in which two sets agree, take the first in this order; before it either set has only parts
in which they differ, and those are d at most.  So tiles of few elements, which strangers
may share, are hardly ever made.  A set whose partners may lie in the next band joins its tiles too.

Groups of near copies have a quadratic number of pairs, so connection is found in rounds.  Each
tile names a leader, and every other set of the tile is verified against it by
intersecting the exact sorted arrays: as many pairs as rows, whatever the size of the
group (a leader's pairs are dealt over many tasks).  Tiles whose sets are connected
then are done.  What is left goes on to bitmaps: in a tile, the parity bitmaps of two sets give a
lower bound of their difference (so an upper bound of their overlap), components with a
pair that passes form a candidate group, and the pairs of a group that aren't connected
yet are bounded by longer bitmaps and verified exactly.  Large tiles and groups are cut into
blocks, and each pair of blocks is a group of its own.  So no link that matters is lost, at any
size, and no task holds more than two blocks.

Tiles that thousands share are found in a sample of the classes first; their leader is
known then, so their rows need not meet in one task.  The sample decides about this layout only.

Where the links are asked for (`class_links`, `link_counts`), no pair that the bitmaps allow is
skipped: all pairs of a candidate group are verified, and the components follow from the links.

Equal sets are one class from the start (two 64-bit sums and the size name it; its number is
that of its first row), and only one document of a class makes tiles.  Links, classes and
components stay in tables, which are deleted when nothing reads them any more; the driver sees counts only.

Defined results: a null or blank text has no shingles, size 0, and is linked with
nothing; fewer words than a shingle has make one shingle; repeated rows link with each other;
rows with a null doc_id get the smallest doc_id of their component, or null.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, mix64, packed, slices

#: Fewest and most bits of a signature in a tile.
BITS, MOST_BITS = 256, 1 << 16
#: Sets of a tile that one group of rows holds; larger tiles are cut and their blocks paired.
BLOCK = 1024
#: Sets and elements of a candidate group that one task resolves; of larger groups, blocks of half of this are paired.
GROUP_SETS, GROUP_ELEMENTS = 1024, 1_000_000
#: Partners of one leader that one task verifies.
PARTNERS = 512
#: Bytes of bitmaps that a task holds at once.
BITMAP_BYTES = 16 << 20
#: A tile is common if this many classes of one SAMPLE-th have it.
SAMPLE, COMMON = 64, 64
#: Tables of ids (up to 40 bytes a row) are broadcast up to this number of rows, and joined by shuffle beyond; the results agree.
BROADCAST_IDS = 1_000_000
#: Rounds of leaders before the bitmaps.
ROUNDS = 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Rule(NamedTuple):
    """When two texts are linked: words a shingle, and the similarity as a fraction."""

    width: int
    num: int
    den: int

    def slack(self, a: int, b: int) -> int:
        """Elements in which linked sets of these sizes differ at most."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest(self, n: int) -> int:
        """The largest partner of a set of n."""
        return n * self.den // self.num


#: What the contract of op4 asks for.
OP4 = Rule(3, 9, 10)
#: What stages that drop near copies take.
NEAR = Rule(5, 4, 5)


def _parts(band: int) -> int:
    return 4 * 3**band


def band_of(n: int, rule: Rule) -> int:
    """The first band with at least five quarters of the parts that a set of n asks for."""
    wanted, band = 5 * (rule.slack(n, rule.largest(n)) + 1), 0
    while 4 * _parts(band) < wanted:
        band += 1
    return band


@cache
def _cuts(parts: int) -> np.ndarray:
    return np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)


@cache
def _tile_bits(band: int, rule: Rule) -> int:
    """Bits of the bitmaps in a band: about four for each element of its smallest set."""
    n = bisect_left(range(1 << 31), band, key=lambda k: band_of(rule.largest(k), rule))
    return min(MOST_BITS, max(BITS, 1 << max(0, 4 * n - 1).bit_length()))


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text's words."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    s = np.full(n, min(width, len(w)), np.uint64)
    for k in range(min(width, len(w))):
        s = mix64(s * _A + w[k : k + n] * _B)
    return np.unique(s)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 bytes, A-Z in lower case (both methods know ASCII only)."""
    return text.lower().split() if text else []


def tiles(s: np.ndarray, rule: Rule) -> np.ndarray:
    """The tiles of a set: for its band, and for later ones if a partner may be there. The last four bits tell the band."""
    n = len(s)
    slack = rule.slack(n, rule.largest(n))
    if not n or not slack:
        return np.zeros(0, np.int64)
    total, out = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s ^ _A))]), []
    for band in range(band_of(n, rule), band_of(rule.largest(n), rule) + 1):
        parts = _parts(band)
        ends = np.concatenate([[0], np.searchsorted(s, _cuts(parts)), [n]])
        size, sums = ends[1:] - ends[:-1], total[ends[1:]] - total[ends[:-1]]
        own = mix64(sums + mix64(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 40)))
        first = np.lexsort((own, -size))[: slack + 1]
        out.append((own[first] & ~np.uint64(15)) | np.uint64(min(band, 15)))
    return np.concatenate(out).view(np.int64)


def signature(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity of the number of elements at each bit: the xor of two is the parity of what they don't share."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def _names(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = (mix64(s ^ x).sum(dtype=np.uint64) * _A + np.uint64(len(s)) for x in (_A, _B))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key")


def describe(documents: DataFrame, rule: Rule = OP4) -> DataFrame:
    """doc_id, key (names the row where doc_id is null), n, a and b (what names the set), tiles."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for some in slices(batch):
                    sets = [shingles(words_of(t), rule.width) for t in some.column("text").cast(pa.binary()).to_pylist()]
                    names = [_names(s) for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("doc_id"), some.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()),
                            pa.array([b for _, b in names], pa.int64()), packed([tiles(s, rule) for s in sets]),
                        ],
                        names=["doc_id", "key", "n", "a", "b", "tiles"],
                    )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), "text").mapInArrow(run, "doc_id long, key long, n long, a long, b long, tiles array<long>")


def _hint(ids: DataFrame):
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


class Classes:
    """The documents' classes, and the tiles that several classes share; what later steps read."""

    def __init__(self, documents: DataFrame, rule: Rule):
        self.rule, self.documents, self.scratch = rule, documents.select("doc_id", "text"), Scratch(documents.sparkSession)
        keep = self.scratch.table
        described = keep(describe(self.documents, rule).withColumn("row", F.monotonically_increasing_id()))
        many = described.where("n > 0").groupBy("a", "b").agg(F.min("row").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
        many = keep(many)
        #: row, doc_id, key, n, a, b, cls: a row per row of the documents. Sets without elements are each a class.
        rows = described.drop("tiles").join(_hint(many), ["a", "b"], "left")
        self.rows = keep(rows.withColumn("cls", F.when(F.col("n") > 0, F.coalesce("first", "row")).otherwise(F.col("row"))).drop("first"))
        copies = self.rows.where("row <> cls").select("row")
        own = described.where(F.size("tiles") > 0).select("row", "tiles").join(_hint(copies), "row", "left_anti").select(F.col("row").alias("cls"), "tiles")
        #: tile, lead, cls of the tiles that two classes or more share. The lead is one of them.
        self.shared = keep(self._shared(own))
        self.scratch.drop(described, many)
        self.sets = keep(self._arrays())

    def _shared(self, own: DataFrame) -> DataFrame:
        sample = own.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLE)) == 0).select(F.explode("tiles").alias("tile"), "cls")
        common = sample.groupBy("tile").agg(F.count("*").alias("k"), F.min("cls").alias("lead")).where(F.col("k") >= COMMON).drop("k")
        common = self.scratch.table(common)
        every = own.select(F.explode("tiles").alias("tile"), "cls")
        if common.isEmpty():
            return _led(every)
        rows = every.join(_hint(common), "tile", "left")
        return rows.where("lead is not null").select("tile", "lead", "cls").unionByName(_led(rows.where("lead is null").select("tile", "cls")))

    def _arrays(self) -> DataFrame:
        """cls, n, s of the classes with shared tiles: the exact sorted arrays."""
        wanted = self.scratch.table(self.shared.select("cls").distinct().join(self.rows.where("row = cls").select("cls", "key", "a", "b"), "cls"))
        rule = self.rule

        def run(batches):
            with np.errstate(over="ignore"):
                for batch in batches:
                    for some in slices(batch):
                        sets = [shingles(words_of(t), rule.width) for t in some.column("text").cast(pa.binary()).to_pylist()]
                        # A key that stands in several rows may have other texts.
                        names = zip(some.column("a").to_pylist(), some.column("b").to_pylist())
                        on = [k for k, (s, name) in enumerate(zip(sets, names)) if _names(s) == name]
                        own = [sets[k] for k in on]
                        yield pa.RecordBatch.from_arrays([some.column("cls").take(pa.array(on, pa.int64())), pa.array([len(s) for s in own], pa.int64()), packed(own)], names=["cls", "n", "s"])

        docs = self.documents.select(_key(), "text").join(_hint(wanted), "key")
        out = docs.select("cls", "a", "b", "text").mapInArrow(run, "cls long, n long, s array<long>")
        # Only where a doc_id is not one of its own can a class come twice.
        twice = self.rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
        return out if wanted.join(twice, "key", "left_semi").isEmpty() else out.dropDuplicates(["cls"])

    def close(self) -> None:
        self.scratch.drop(self.shared, self.sets)


def _led(every: DataFrame) -> DataFrame:
    """tile, lead (its smallest class), cls of the rows of tiles that two rows or more have. The sorted rows run through; nothing is gathered."""

    def run(batches):
        tile = lead = None
        alone = False  # whether the row held so far is its tile's only one
        for batch in batches:
            if not len(batch):
                continue
            t, c = batch.column("tile").to_numpy(), batch.column("cls").to_numpy()
            new = np.concatenate([[tile is None or t[0] != tile], t[1:] != t[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            first = np.where(at >= 0, c[at], lead if lead is not None else 0)
            # A row stays if a row of its tile stands before or after it; the last one waits.
            more = np.concatenate([~new[1:], [False]])
            stays = ~new | more
            out = [t[stays], first[stays], c[stays]]
            if alone and not new[0]:
                out = [np.concatenate([[x], o]) for x, o in zip((tile, lead, lead), out)]
            alone = bool(new[-1])
            tile, lead = t[-1], first[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["tile", "lead", "cls"])

    return every.repartition("tile").sortWithinPartitions("tile", "cls").mapInArrow(run, "tile long, lead long, cls long")


def verified(pairs: DataFrame, classes: Classes) -> DataFrame:
    """x, y, overlap of the linked ones of pairs(x, y); classes are compared by their exact arrays.

    Pairs are dealt by x, and those of an x with many partners over several tasks; a task reads the array of x and then its partners'.
    """
    sets, rule, keep = classes.sets, classes.rule, classes.scratch.table
    sizes = pairs.groupBy("x").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("deals"))
    dealt = keep(pairs.join(sizes, "x").withColumn("deal", F.pmod(F.xxhash64("y"), F.col("deals")).cast("int")).drop("deals"))
    partners = sets.join(_hint(dealt), F.col("y") == F.col("cls")).select("x", "deal", F.lit(1).alias("role"), "y", "n", "s")
    leads = keep(dealt.select("x", "deal").distinct())
    leaders = sets.join(_hint(leads), F.col("x") == F.col("cls")).select("x", "deal", F.lit(0).alias("role"), F.col("x").alias("y"), "n", "s")

    def run(batches):
        at, lead = None, None
        for batch in batches:
            x, role, y, n = (batch.column(c).to_numpy() for c in ("x", "role", "y", "n"))
            s = batch.column("s")
            values, ends = s.values.to_numpy(), s.offsets.to_numpy()
            found = []
            for k in range(len(x)):
                own = values[ends[k] : ends[k + 1]]
                if not role[k]:
                    at, lead = x[k], own.copy()
                elif at == x[k] and rule.num * max(len(own), len(lead)) <= rule.den * min(len(own), len(lead)):
                    same = len(np.intersect1d(lead, own, assume_unique=True))
                    if rule.den * same >= rule.num * (len(own) + len(lead) - same):
                        found.append((x[k], y[k], same))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["x", "y", "overlap"])

    rows = leaders.unionByName(partners).repartition("x", "deal").sortWithinPartitions("x", "deal", "role")
    return rows.mapInArrow(run, "x long, y long, overlap long")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (tile, blocks, cls, ...) by tile and pair of blocks; a tile of one block is one group."""
    b = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    j = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in rows.columns if c not in ("tile", "blocks")]
    cut = rows.select("*", b.alias("b"), j.alias("j")).select("tile", F.least("b", "j").alias("b1"), F.greatest("b", "j").alias("b2"), *rest)
    return cut.repartition("tile", "b1", "b2").sortWithinPartitions("tile", "b1", "b2", "cls")


def _whole_groups(frames, keys: list[str]):
    """Frames of sorted rows, cut so that no group of equal keys is split; with where each group starts, and the end."""
    held: list[pd.DataFrame] = []
    for rows in frames:
        if not len(rows):
            continue
        key = rows[keys].to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if held and (key[0] != held[-1][keys].to_numpy()[-1]).any():
            edge = np.concatenate([[0], edge])
        if not len(edge):
            held.append(rows)
            continue
        done = [*held, rows.iloc[: edge[-1]]]
        shift = sum(map(len, held))
        starts = np.concatenate([[0], edge + shift])
        held = [rows.iloc[edge[-1] :]]
        yield pd.concat(done, ignore_index=True) if len(done) > 1 else done[0], np.unique(starts)
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, np.array([0, len(rows)])


def _index_pairs(starts: np.ndarray):
    """All pairs of rows of the same group, some at a time."""
    sizes = np.diff(starts)
    for k in np.unique(sizes[sizes > 1]):
        own = starts[:-1][sizes == k]
        if k <= 64:
            i, j = np.triu_indices(int(k), 1)
            step = max(1, 100_000 // len(i))
            for a in range(0, len(own), step):
                yield (own[a : a + step, None] + i).ravel(), (own[a : a + step, None] + j).ravel()
        else:
            for o in own:
                for r in range(o, o + k, 64):
                    i, j = np.meshgrid(np.arange(r, min(r + 64, o + k)), np.arange(r, o + k), indexing="ij")
                    yield i[i < j], j[i < j]


def _may_link(i, j, n, sig, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that sizes and bitmaps allow, and how much they differ at least."""
    on = rule.num * np.maximum(n[i], n[j]) <= rule.den * np.minimum(n[i], n[j])
    i, j = i[on], j[on]
    step = max(1, BITMAP_BYTES // 16 // sig.shape[1])
    differ = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(sig[i[a : a + step]] ^ sig[j[a : a + step]]).sum(axis=1, dtype=np.int64) for a in range(0, len(i), step))])
    on = (rule.den + rule.num) * differ <= (rule.den - rule.num) * (n[i] + n[j])
    return i[on], j[on], differ[on]


def _signatures(sets: DataFrame) -> DataFrame:
    """cls, n, sig: bitmaps of about four bits for each element."""

    def run(batches):
        for batch in batches:
            s = batch.column("s")
            values, ends = s.values.to_numpy().view(np.uint64), s.offsets.to_numpy()
            own = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
            sig = [signature(x, min(MOST_BITS, max(BITS, 1 << int(4 * len(x) - 1).bit_length()))).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(sig, pa.binary())], names=["cls", "n", "sig"])

    return sets.select("cls", "n", "s").mapInArrow(run, "cls long, n long, sig binary")


def _folded(sig: bytes, bits: int) -> np.ndarray:
    """A longer bitmap as one of `bits` bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sig, np.uint64).reshape(-1, bits // 64), axis=0)


def _candidate_edges(rows: DataFrame, rule: Rule) -> DataFrame:
    """x, y of rows(tile, blocks, cls, comp, n, sig): components of a tile that a pair connects which the bitmaps allow, each with the smallest in its row."""

    def run(frames):
        for some, starts in _whole_groups(frames, ["tile", "b1", "b2"]):
            bands = some["tile"].to_numpy()[starts[:-1]] & 15
            for band in np.unique(bands):
                bits = _tile_bits(int(band), rule)
                on, lo = bands == band, 0
                sizes = np.diff(starts)[on]
                groups = starts[:-1][on]
                while lo < len(groups):
                    # As many groups at once as their bitmaps may take.
                    hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), BITMAP_BYTES * 8 // bits, "right")))
                    take = np.concatenate([np.arange(a, a + k) for a, k in zip(groups[lo:hi], sizes[lo:hi])])
                    yield _joined(some.iloc[take], np.concatenate([[0], np.cumsum(sizes[lo:hi])]), bits, rule)
                    lo = hi

    return _in_blocks(rows).mapInPandas(run, "x long, y long").distinct()


def _joined(some: pd.DataFrame, starts: np.ndarray, bits: int, rule: Rule) -> pd.DataFrame:
    n, sig = some["n"].to_numpy(np.int64), np.stack([_folded(x, bits) for x in some["sig"]])
    names, comp = np.unique(some["comp"].to_numpy(np.int64), return_inverse=True)
    own = np.arange(len(names))
    for i, j in _index_pairs(starts):
        new = own[comp[i]] != own[comp[j]]  # those that are joined already tell nothing new
        i, j, _ = _may_link(i[new], j[new], n, sig, rule)
        i, j = comp[i], comp[j]
        while len(i):
            low, high = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
            if (low == high).all():
                break
            np.minimum.at(own, high, low)
            own = own[own]
    while (own[own] != own).any():
        own = own[own]
    on = own != np.arange(len(own))
    return pd.DataFrame({"x": names[on], "y": names[own[on]]})


def merged(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """cls, comp (the smallest class connected) from edges(x, y), by hooking and doubling pointers."""
    keep = scratch.table
    both = keep(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct())
    labels = keep(both.select(F.col("x").alias("cls")).distinct().withColumn("comp", F.col("cls")))
    while not both.isEmpty():
        hooks = both.groupBy(F.col("x").alias("c")).agg(F.min("y").alias("p")).where("p < c")
        roots = _roots(keep(hooks), scratch)
        root = roots.withColumnRenamed("c", "comp")
        labels = keep(labels.join(root, "comp", "left").select("cls", F.coalesce("root", "comp").alias("comp")))
        of = lambda c: roots.select(F.col("c").alias(c), F.col("root").alias(f"r{c}"))
        after = both.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
        both = keep(after.where("x <> y").distinct())
    return labels


def _roots(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """c, root of hooks(c, p): every p is below its c, so pointers are doubled until none moves."""
    while True:
        up = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        hooks = scratch.table(hooks.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        if hooks.where("moved").isEmpty():
            return hooks.select("c", F.col("p").alias("root"))
        hooks = hooks.select("c", "p")


def _bitmaps(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Bitmaps of one group, as long as its sets ask for and its number allows: short ones fill up and tell nothing."""
    bits = max(BITS, 1 << int(2 * n.max() - 1).bit_length())
    while bits > BITS and bits * len(sets) > BITMAP_BYTES * 8:
        bits //= 2
    return np.stack([signature(s.view(np.uint64), bits) for s in sets])


def _pairs_of(some: pd.DataFrame, lo: int, hi: int, apart: np.ndarray | None, rule: Rule):
    """The pairs (i, j, differ) of the rows lo to hi that sizes and bitmaps allow; `apart`: labels that have to differ."""
    n = some["n"].to_numpy(np.int64)[lo:hi]
    sets = some["s"].tolist()[lo:hi]
    sig = _bitmaps(sets, n)
    for i, j in _index_pairs(np.array([0, hi - lo])):
        if apart is not None:
            new = apart[i] != apart[j]
            i, j = i[new], j[new]
        i, j, differ = _may_link(i, j, n, sig, rule)
        for k in np.argsort(differ, kind="stable"):
            yield i[k], j[k], n, sets


def _linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> int:
    """The overlap of two sets that are linked, else 0."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same if rule.den * same >= rule.num * (len(a) + len(b) - same) else 0


def _sides(block: np.ndarray) -> np.ndarray | None:
    """What has to differ in a pair: the blocks, if a group has two (each has been compared by itself)."""
    return None if (block == block[0]).all() else block


def _resolve(rows: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """x, y of rows(keys, b, cls, comp, n, s): links that connect what wasn't; `comp` is what is known before.

    Rows of the same block `b` have been compared if the group has two blocks.
    """

    def run(frames):
        for some, starts in _whole_groups(frames, keys):
            cls, found = some["cls"].to_numpy(np.int64), []
            for lo, hi in zip(starts[:-1], starts[1:]):
                _, own = np.unique(some["comp"].to_numpy(np.int64)[lo:hi], return_inverse=True)
                for i, j, _, sets in _pairs_of(some, lo, hi, _sides(some["b"].to_numpy(np.int64)[lo:hi]), rule):
                    if own[i] != own[j] and _linked(sets[i], sets[j], rule):
                        own[own == own[i]] = own[j]
                        found.append((cls[lo + i], cls[lo + j]))
            yield pd.DataFrame(found, columns=["x", "y"]).astype("int64")

    return rows.repartition(*keys).sortWithinPartitions(*keys, "cls").mapInPandas(run, "x long, y long")


def _exact_links(rows: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """x, y, overlap of rows(keys, b, cls, n, s): every linked pair of classes of a group, x below y.

    Rows of the same block `b` are compared only if the group has one block.
    """

    def run(frames):
        for some, starts in _whole_groups(frames, keys):
            cls = some["cls"].to_numpy(np.int64)
            for lo, hi in zip(starts[:-1], starts[1:]):
                found = []
                for i, j, _, sets in _pairs_of(some, lo, hi, _sides(some["b"].to_numpy(np.int64)[lo:hi]), rule):
                    if same := _linked(sets[i], sets[j], rule):
                        x, y = cls[lo + i], cls[lo + j]
                        found.append((min(x, y), max(x, y), same))
                    if len(found) == 100_000:
                        yield pd.DataFrame(found, columns=["x", "y", "overlap"]).astype("int64")
                        found = []
                yield pd.DataFrame(found, columns=["x", "y", "overlap"]).astype("int64")

    rows = rows.select(*keys, *(c for c in ("b", "cls", "n", "s") if c not in keys))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "cls").mapInPandas(run, "x long, y long, overlap long")


def _grouped(rows: DataFrame, classes: Classes) -> DataFrame:
    """grp, blocks, b, cls, comp, n, s of rows(tile, cls, comp): components that bitmaps allow to be connected have the same grp."""
    keep, sets = classes.scratch.table, classes.sets
    k = rows.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = keep(rows.select("cls", "comp").distinct())
    sigs = _signatures(sets.join(_hint(wanted.select("cls")), "cls", "left_semi"))
    edges = keep(_candidate_edges(rows.join(k, "tile").join(keep(sigs), "cls"), classes.rule))
    groups = merged(edges, classes.scratch).select(F.col("cls").alias("comp"), F.col("comp").alias("grp"))
    own = keep(wanted.join(groups, "comp").join(sets.select("cls", "n"), "cls"))
    load = F.count("*") + F.ceil(F.sum("n") * (GROUP_SETS / GROUP_ELEMENTS))
    blocks = own.groupBy("grp").agg(load.alias("load")).select("grp", F.when(F.col("load") <= GROUP_SETS, 1).otherwise(F.ceil(2 * F.col("load") / GROUP_SETS)).cast("int").alias("blocks"))
    own = own.drop("n").join(blocks, "grp").withColumn("b", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    return keep(sets.join(_hint(keep(own)), "cls"))


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Rows of larger groups by every pair b1, b2 of their blocks."""
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("b")))
    return rows.withColumn("j", other).withColumn("b1", F.least("b", "j")).withColumn("b2", F.greatest("b", "j")).drop("j", "blocks")


def _open_tiles(shared: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """tile, lead, led (the lead's component), cls, comp of the tiles whose classes aren't all connected; the lead changes with `turn`."""
    rows = shared.select("tile", "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lead = F.min_by(F.struct("cls", "comp"), F.xxhash64("cls", F.lit(turn)))
    tiles_ = rows.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), lead.alias("l")).where("lo < hi")
    return rows.join(tiles_.select("tile", F.col("l.cls").alias("lead"), F.col("l.comp").alias("led")), "tile")


def components(classes: Classes) -> DataFrame:
    """cls, comp of the classes that are linked with another; comp names a connected component."""
    keep, rule = classes.scratch.table, classes.rule
    pairs = keep(classes.shared.where("lead <> cls").select(F.col("lead").alias("x"), F.col("cls").alias("y")).distinct())
    links = keep(verified(pairs, classes).select("x", "y"))
    labels = merged(links, classes.scratch)
    left = keep(_open_tiles(classes.shared, labels, 0))
    for turn in range(1, ROUNDS):
        if left.isEmpty():
            break
        pairs = keep(left.where("comp <> led").select(F.col("lead").alias("x"), F.col("cls").alias("y")).distinct())
        more = keep(verified(pairs, classes).select("x", "y"))
        links = links.union(more)
        if not more.isEmpty():
            labels = merged(links, classes.scratch)
            left = keep(_open_tiles(left, labels, turn))
    if left.isEmpty():
        return labels
    rows = _grouped(left.select("tile", "cls", "comp"), classes)
    more = _resolve(rows, ["grp", "b"], rule).union(_resolve(_block_pairs(rows.where("blocks > 1")), ["grp", "b1", "b2"], rule))
    more = keep(more)
    return labels if more.isEmpty() else merged(links.union(more), classes.scratch)


def class_links(classes: Classes) -> DataFrame:
    """x, y, overlap: all links between different classes, as a table; each pair once, x below y."""
    rows = _grouped(classes.shared.select("tile", "cls", F.col("cls").alias("comp")), classes)
    found = _exact_links(rows, ["grp", "b"], classes.rule).union(_exact_links(_block_pairs(rows.where("blocks > 1")), ["grp", "b1", "b2"], classes.rule))
    return classes.scratch.table(found)


def link_counts(documents: DataFrame, rule: Rule = OP4) -> DataFrame:
    """doc_id, class_id, component_id, n_links: a row per row of `documents`, with the number of other rows it links with.

    Rows of the same class_id have equal sets and link with each other; rows without shingles have no class.
    """
    classes = Classes(documents, rule)
    links = class_links(classes)
    classes.close()
    some = classes.rows.where("n > 0")
    sizes = some.groupBy("cls").agg(F.count("*").alias("size"))
    both = links.select("x", "y").union(links.select("y", "x"))
    near = both.join(sizes, both["y"] == sizes["cls"]).groupBy("x").agg(F.sum("size").alias("near")).withColumnRenamed("x", "cls")
    rows = classes.rows.join(sizes, "cls", "left").join(near, "cls", "left").join(merged(links, classes.scratch), "cls", "left")
    rows = rows.withColumn("comp", F.coalesce("comp", "cls"))
    least = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    on = F.col("n") > 0
    return rows.join(least, "comp", "left").select(
        "doc_id",
        F.when(on, F.col("cls")).alias("class_id"),
        F.when(on, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(on, F.col("size") - 1 + F.coalesce("near", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def link(documents: DataFrame, rule: Rule = OP4) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of `documents`."""
    classes = Classes(documents, rule)
    found = components(classes)
    classes.close()
    rows = classes.rows.select("doc_id", "n", "cls").join(found, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def one_of_each(documents: DataFrame, rule: Rule = OP4) -> DataFrame:
    """The rows whose doc_id is the smallest of its component, unchanged; rows without shingles or doc_id all stay."""
    scratch = Scratch(documents.sparkSession)
    own = link(documents, rule).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = scratch.table(own.where("not stays").select(F.col("doc_id").alias("_gone")))
    # The documents' own columns keep their names, whatever they are.
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")).withColumn("_gone", F.col("_row.doc_id").cast("long"))
    return row.join(_hint(gone), "_gone", "left_anti").select("_row.*")

"""Token alignment, source divergence and SimHash copies against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import divergence, simhash, token_align
from glyphmill.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("row", "stripe", "deal", "kind", "fp", "cell", "term", "n", "v", "z", "item", "rank", "comp", "cls", "code", "codes")
VOCABULARIES = Path(token_align.FOLDER)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCS)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("1"))
    return df.repartition(parts)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß雨") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    say = lambda k: rng.choice([" ", "\n", "  ", ", "]).join(rng.choice(words).title() for _ in range(k))
    rows = [(i, say(rng.randint(1, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "", "c c", None, "\U0001f600", "￿"])) for i in range(n)]
    rows += [(i, rows[i % 30][1], "en", "a") for i in range(n, n + 40)]
    rows += [(900, None, "en", "a"), (901, "", "xx", "only"), (902, " \n\t ", "en", "z"), (903, "one", "en", "a"), (904, "12 3", "en", "empty"), (905, "x▁y z", "en", "a"), (906, say(20_000), "de", "a")]
    rows += [(None, say(30), "en", "b"), (None, say(30), "en", "b"), (5, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a"), (907, "<|endoftext|> </s> <s> \x00\x01 \U0001f468‍\U0001f469 <0x41> \r\n\t", "en", "a")]
    return rows


# 11


@pytest.fixture(scope="module")
def sides():
    if not VOCABULARIES.exists():
        pytest.skip("needs the vocabulary files")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(str(VOCABULARIES / "byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=str(VOCABULARIES / "piece_bpe_32k.model"))


def plain_alignment(rows, a, b):
    """Token by token, with the libraries that the files are named for."""
    chars = {c: i for i, c in enumerate(chr(x) for x in [*range(33, 127), *range(161, 173), *range(174, 256)])}
    others = [x for x in range(256) if not (33 <= x < 127 or 161 <= x < 173 or 174 <= x < 256)]
    by_char = {c: ord(c) for c in chars} | {chr(256 + k): x for k, x in enumerate(others)}
    done, total = [], Counter()
    for i, text, *_ in rows:
        ids = (a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or ""))
        ends, whole = [], b" " + (text or "").encode()
        for side, own in enumerate(ids):
            said = []
            for k in own:
                if side:
                    p = b.id_to_piece(k)
                    said.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
                else:
                    said.append(bytes(by_char[c] for c in a.id_to_token(k)))
            ends.append({e: k + 1 for k, e in enumerate(accumulate(map(len, said)))} if text and b"".join(said) == whole else None)
        if None in ends:
            done.append((i, [], [], []))
            continue
        groups, links, lo = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            hi = [ends[s][e] for s in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[s][lo[s] : hi[s]])) for s in (0, 1)))
            links.append((ids[0][hi[0] - 1], ids[1][hi[1] - 1]))
            lo = hi
        total.update(links)
        done.append((i, ids, groups, links))
    best = defaultdict(int)
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return Counter(
        (i, len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if ids else "")
        for i, ids, groups, links in done
    )


@pytest.mark.parametrize("deal", [1 << 25, 40])
def test_alignment(spark, sides, monkeypatch, deal):
    monkeypatch.setattr(token_align, "DEAL_BYTES", deal)  # one task a stripe, or many
    rows = corpus()
    got = token_align.align(frame(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == plain_alignment(rows, *sides)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_fast_encoding_is_that_of_the_file(sides):
    rng = random.Random(4)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'LL", "'ll", "1", "23", "é", "雨", " ", "　", "<|endoftext|>", "!", "...", "\U0001f600", "́", "\r\n", "Q", "_", "\x00", "▁"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + [" " * 5000, "a" * 50_000, "\n" * 3000 + "x", "ab" * 20_000]
    side = token_align.byte_bpe((VOCABULARIES / "byte_bpe_50k.json").read_bytes())
    assert [list(x) for x in side.encode(texts)] == [e.ids for e in sides[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_alignment_of_nothing(spark, sides):
    none = spark.createDataFrame([], DOCS)
    assert token_align.align(none).count() == 0
    empty = frame(spark, [(1, None, "en", "a"), (2, "", "en", "a")])
    assert sorted(tuple(r) for r in token_align.align(empty).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# 12


def plain_audit(rows, least=10, top=10, unit=1_000_000_000):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [(s, [low(t) for t in w]) for x, s, w in docs if x == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        count = defaultdict(Counter)
        for s, w in own:
            count[s].update(w)

        def shares(n):
            total = sum(n[t] for t in kept) + 2 * len(kept)
            return {t: 1 + unit * (n[t] + 2) // total for t in kept}

        p, q = {s: shares(n) for s, n in count.items()}, shares(sum(count.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in p:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(sorted(term)[:top])]
    return sorted(out)


@pytest.mark.parametrize("sources, held, least", [(1000, 300_000, 10), (2, 20, 3)])
def test_divergence(spark, monkeypatch, sources, held, least):
    monkeypatch.setattr(divergence, "SOURCES", sources)  # one bucket of sources, or several
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus()
    got = divergence.audit(frame(spark, rows), least)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, least)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_divergence_of_counts_beyond_a_long(spark):
    rows = spark.createDataFrame([(20_000_000_000, 30_000_000_000, 5)], "n long, total long, v long")
    assert rows.select(divergence._share("n", "total", 10**9)).collect()[0][0] == 1 + 10**9 * (20_000_000_000 + 2) // (30_000_000_000 + 10)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    blank = frame(spark, [(1, None, "en", "a"), (2, "", "en", "b"), (3, "7", None, None)])
    assert sorted(tuple(r) for r in divergence.audit(blank).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# 13


def plain_fingerprint(text):
    w = [low(x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_copies(rows, fps):
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))


def near_rows():
    """Long texts of which some words change, so that fingerprints differ in a few bits."""
    rng = random.Random(6)
    rows = corpus()
    for _ in range(12):
        w = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for _ in range(rng.randint(2, 9)):
            w = list(w)
            w[rng.randrange(300)] = "other"
            rows.append((1000 + len(rows), " ".join(w), "en", "a"))
    return rows


@pytest.mark.parametrize("axes", [None, 5, 8])
def test_simhash(spark, axes):
    rows = near_rows()
    fps = [plain_fingerprint(r[1]) for r in rows]
    got = simhash.near_copies(frame(spark, rows), axes)
    assert Counter(tuple(r) for r in got.collect()) == plain_copies(rows, fps)
    assert len({r["component_id"] for r in got.collect()}) < len(set(fps))


def planted(n=700, seed=8):
    """Points in chains and clouds, so that cells are crowded."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2)
    out = []
    for _ in range(n):
        x = int(rng.choice(centres))
        for b in rng.choice(14, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b) * 4
        out.append(x)
    return sorted({*out, *map(int, rng.integers(0, 1 << 63, 200))})


def test_crowded_cells(spark, monkeypatch):
    points = planted()
    rows = [(k,) for k in points]
    want = plain_copies(rows, points)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in points], "fp long").repartition(3)
    ids = {x: c for (_, x, c), _ in want.items()}
    sizes = sorted(Counter(ids.values()).values())
    assert max(sizes) > 50
    for sample, common, block, pairs in ((32, 64, 2048, 64), (1, 8, 16, 4), (1, 2, 5, 2)):
        for name, x in (("SAMPLE", sample), ("COMMON", common), ("BLOCK", block), ("ALL_PAIRS", pairs)):
            monkeypatch.setattr(simhash, name, x)
        got = defaultdict(set)
        for r in simhash.components(df, Scratch(spark)).collect():
            got[r["comp"]].add(f"{r['cls'] % (1 << 64):016x}")
        groups = defaultdict(set)
        for x, c in ids.items():
            groups[c].add(x)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_the_distance_of_counts_is_a_lower_bound():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    counts = lambda v: np.stack([np.bitwise_count((v >> np.uint64(2 * k)) & np.uint64(3)).astype(int) for k in range(32)])
    apart = np.abs(counts(x) - counts(y)).sum(axis=0)
    assert (np.bitwise_count(simhash.unary(x) ^ simhash.unary(y)) == apart).all() and (apart <= np.bitwise_count(x ^ y)).all()
    assert [len(simhash.tables_of(n)) for n in (5, 6, 8)] == [5, 15, 70]
    assert [simhash.axes_for(n) for n in (0, 10**6, 10**10)] == sorted(simhash.axes_for(n) for n in (0, 10**6, 10**10))


def test_simhash_of_nothing(spark):
    assert simhash.near_copies(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("op", [simhash.near_copies, divergence.audit, token_align.align])
def test_only_the_result_stays_in_the_shared_folder(spark, op):
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if spark.sparkContext.getCheckpointDir() else None
    before = set(folder.glob("scratch-*/*")) if folder else set()
    op(frame(spark, corpus(n=40))).count()
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert len(set(folder.glob("scratch-*/*")) - before) == 1

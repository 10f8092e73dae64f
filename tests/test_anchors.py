"""Anchored matching of lines, and near-equal texts, against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import anchors, repair


def plain_blocks(a, b):
    """Line by line: anchors, a longest run of them by looking at all earlier ones, then what grows from each end of a gap."""
    once = [{x: i for i, x in enumerate(side) if side.count(x) == 1} for side in (a, b)]
    both = sorted((i, once[1][x]) for x, i in once[0].items() if x in once[1])
    size = len(anchors._increasing([j for _, j in both]))
    best = [1] * len(both)
    for k, (_, j) in enumerate(both):
        best[k] = 1 + max((best[m] for m in range(k) if both[m][1] < j), default=0)
    assert size == max(best, default=0)
    kept = [both[k] for k in anchors._increasing([j for _, j in both])]
    assert all(x[1] < y[1] for x, y in zip(kept, kept[1:]))
    gaps = [(-1, -1), *kept, (len(a), len(b))]
    match = set(kept)
    for (i, j), (i2, j2) in zip(gaps, gaps[1:]):
        room, n = min(i2 - i, j2 - j) - 1, 0
        while n < room and a[i + n + 1] == b[j + n + 1]:
            n += 1
        m = 0
        while m < room - n and a[i2 - m - 1] == b[j2 - m - 1]:
            m += 1
        match |= {(i + k, j + k) for k in range(1, n + 1)} | {(i2 - k, j2 - k) for k in range(1, m + 1)}
    return {(i, j) for i, j in match if (i - 1, j - 1) not in match}, match


def documents():
    rng = random.Random(3)
    docs = [[f"line {rng.randrange(40)}" for _ in range(rng.randint(0, 40))] for _ in range(8)]
    docs += [[f"own {rng.randrange(500)}" for _ in range(60)] for _ in range(3)]
    for k in range(14):
        d = list(docs[rng.randrange(len(docs))])
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(d) + 1)
            d[at:at] = rng.choice([["new"], d[:3], [f"x{k}", f"y{k}"]])
            if len(d) > 3:
                del d[rng.randrange(len(d))]
        docs.append(d)
    return docs + [["same"] * 9, ["same"] * 6, ["a", "b", "c"], ["c", "a", "b"], [], [""]]


def test_matching_blocks(spark):
    docs = documents()
    rows = [(k, i + 1, x, "extra") for k, d in enumerate(docs) for i, x in enumerate(d)]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, line string, h string").repartition(4)
    pairs = [(x, y) for x in range(len(docs)) for y in range(len(docs)) if x != y]
    wanted = spark.createDataFrame(pairs + pairs[:9], "a long, b long")
    got = {p: set() for p in pairs}
    for r in anchors.matching_blocks(df, wanted).collect():
        block = {(r["a_from"] - 1 + k, r["b_from"] - 1 + k) for k in range(r["size"])}
        assert not block & got[r["a"], r["b"]]
        got[r["a"], r["b"]] |= block
        assert (min(block)[0] - 1, min(block)[1] - 1) not in got[r["a"], r["b"]]
    for x, y in pairs:
        assert got[x, y] == plain_blocks(docs[x], docs[y])[1], (x, y)


def test_matching_lines_go(spark):
    docs = [[f"l{k}" for k in range(20)], ["z", *(f"l{k}" for k in range(4, 12)), "l1", "q"], ["l0", "l1"]]
    df = spark.createDataFrame([(k, i + 1, x) for k, d in enumerate(docs) for i, x in enumerate(d)], "doc_id long, line_no long, line string")
    left = anchors.drop_matching(df, spark.createDataFrame([(0, 1), (0, 2)], "a long, b long"))
    assert Counter((r["doc_id"], r["line"]) for r in left.collect()) == Counter([(0, x) for x in docs[0]] + [(1, "z"), (1, "l1"), (1, "q"), (2, "l0"), (2, "l1")])


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x):
        before, row[0] = row[0], i + 1
        for j, e in enumerate(y):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (c != e))
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_equal_texts(spark, seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcé雨\U0001f600") for _ in range(n))
    cases = []
    for _ in range(250):
        x = say(rng.choice([0, 3, 6, 12, 30, 60]))
        y = list(x)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 2)] = say(rng.randint(0, 2))
        cases.append((x, "".join(y)))
    cases += [(None, "a"), ("a", None), ("", ""), ("", "abcdef")]

    def near(x, y):
        if len(x) < 6 or len(y) < 6:
            return x == y
        d, long = edits(x, y), max(len(x), len(y))
        return d <= max(2, int(long * 8 / 100)) and 20 * (long - d) >= 9 * (len(x) + len(y))

    def cover(x, y):
        if not x or not y or x == y:
            return False
        short = min(len(x), len(y))
        head = next((k for k in range(short) if x[k] != y[k]), short)
        tail = min(short - head, next((k for k in range(short) if x[-1 - k] != y[-1 - k]), short))
        return 5 * (head + tail) >= 4 * short and len(x) + len(y) - 2 * (head + tail) <= 8

    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k long, a string, b string").repartition(3)
    got = df.select("k", repair.near_same(F.col("a"), F.col("b")), repair.affix_cover(F.col("a"), F.col("b"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {k: (None, None) if None in c else (near(*c), cover(*c)) for k, c in enumerate(cases)}

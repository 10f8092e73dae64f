"""Layout covers, as-of joins with a tolerance, transcripts and exclusions against plain versions."""

import random

from glyphmill.operators import joins, layouts, resolve


def plain_cover(pages):
    kept, taken = [], set()
    for p in sorted(pages, key=lambda p: (len(pages[p]), p)):
        if not pages[p] & taken:
            kept.append(p)
            taken |= pages[p]
    out = {p: ("kept", None) for p in kept}
    for p in pages.keys() - set(kept):
        parts = [k for k in kept if pages[k] & pages[p]]
        whole = all(pages[k] <= pages[p] for k in parts) and set().union(*(pages[k] for k in parts)) == pages[p]
        out[p] = ("alternate", sorted(parts)) if whole else ("unproven", None)
    return out


def test_cover(spark):
    rng = random.Random(3)
    pages = {}
    for k in range(40):  # a line of atoms, cut finely and coarsely
        lo = 100 * k
        cuts = sorted(rng.sample(range(1, 12), rng.randint(0, 3)))
        for a, b in zip([0, *cuts], [*cuts, 12]):
            pages[len(pages)] = set(range(lo + a, lo + b))
        if rng.random() < 0.7:
            pages[len(pages)] = set(range(lo, lo + 12))
        if rng.random() < 0.4:
            a = rng.randrange(12)
            pages[len(pages)] = set(range(lo + a, lo + rng.randint(a + 1, 14)))
    pages |= {1000 + k: {9000 + k, 9001 + k} for k in range(9)}  # a chain
    pages |= {2000 + k: {9500} for k in range(60)}  # an atom of many pages
    rows = [(p, a) for p, own in pages.items() for a in own]
    df = spark.createDataFrame(rows + rows[:30] + [(None, 1), (7, None)], "page long, atom long").repartition(4)
    got = {r["page"]: (r["status"], r["parts"]) for r in layouts.cover(df).collect()}
    assert got == plain_cover(pages)
    assert {s for s, _ in got.values()} == {"kept", "alternate", "unproven"}
    assert layouts.cover(df.limit(0)).count() == 0


def test_cover_is_dealt_by_rows(spark, monkeypatch):
    # However many rows there are, a task holds about as many; atoms that no page keeps aren't one task's.
    monkeypatch.setattr(layouts, "ROWS_A_TASK", 25, raising=False)
    pages = {3 * k: {k, 5000 + k} for k in range(100)} | {3 * k + 1: {k, 5000 + k, 7000 + k} for k in range(100)} | {3 * k + 2: {7000 + k, k, 5000 + k, 7001 + k} for k in range(99)}
    out = layouts.cover(spark.createDataFrame([(p, a) for p, own in pages.items() for a in own], "page long, atom long"))
    assert {r["page"]: (r["status"], r["parts"]) for r in out.collect()} == plain_cover(pages)
    assert {r["size"] == len(pages[r["page"]]) for r in out.collect()} == {True}
    assert out.rdd.getNumPartitions() >= 36


def test_asof_within(spark):
    rng = random.Random(5)
    left = [(i, rng.randrange(3), rng.randrange(60)) for i in range(80)]
    right = [(rng.randrange(3), t, f"v{t}") for t in rng.sample(range(60), 20)]
    a, b = spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, v string")
    for within in (None, "3"):
        got = {r["id"]: r["v"] for r in joins.asof(a, b, "k", "t", "v", within=within).collect()}
        for i, k, t in left:
            best = max(((s, v) for q, s, v in right if q == k and s <= t), default=None)
            assert got[i] == (best[1] if best and (within is None or t - best[0] <= 3) else None)


def test_transcripts_and_exclusions(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "b")], "n long, id string")
    known = spark.createDataFrame([("a", "two"), ("a", "one"), ("b", "  "), (None, "x")], "id string, text string")
    found, missing = resolve.transcribed(rows, known, "id")
    assert {r["n"]: (r["text"], r["missing"]) for r in found.collect()} == {1: ("one", False), 2: ("[missing b]", True), 3: ("[missing c]", True), 4: (None, False), 5: ("[missing b]", True)}
    assert {tuple(r) for r in missing.collect()} == {("b", 2), ("c", 1)}
    told = resolve.excluded(rows, [("id", "^[ab]", "first"), ("id", "b|c", "second")], "n = 5")
    assert {r["n"]: r["reason"] for r in told.collect()} == {1: "first", 2: "first", 3: "second", 4: None, 5: None}
    assert {r["reason"] for r in resolve.excluded(rows, []).collect()} == {None}

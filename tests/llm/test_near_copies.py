"""The stage of the pipeline that drops near copies: five words a shingle, similarity four fifths."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from glyphmill.llm import ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_links(sets, num, den):
    for j in range(len(sets)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                yield i, j, both


def plain_kept(rows):
    """doc_ids of the smallest of each component; ids are distinct."""
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j, _ in plain_links(plain_sets([r[1] for r in rows], 5), 4, 5):
        a, b = find(i), find(j)
        if rows[a][0] > rows[b][0]:
            a, b = b, a
        up[b] = a
    return sorted(r[0] for i, r in enumerate(rows) if find(i) == i)


def near_copies(seed=3, n=60, most=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, most))]
        rows.append((len(rows), " ".join(w), "en", "ab"[i % 2], 1))
        for _ in range(rng.randint(0, 3)):
            copy = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy[: len(copy) - rng.randint(0, len(copy) // 20)]), "en", "ab"[i % 2], 1))
    return rows + [(len(rows), None, "en", "a", 0), (len(rows) + 1, " ", "en", "b", 1)]


def test_two_words_far_apart_of_a_hundred(spark):
    w = [f"w{i}" for i in range(100)]
    other = [*w[:30], "x", *w[31:70], "y", *w[71:]]
    docs = spark.createDataFrame([(1, " ".join(w), "en", "a", 1), (2, " ".join(other), "en", "a", 1)], DOCS)
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [1]
    assert sorted(r["component_id"] for r in ngram_join.link(docs).collect()) == [1, 2]


@pytest.mark.parametrize("rule", [ngram_join.OP4, ngram_join.NEAR])
def test_linked_sets_share_a_tile(rule):
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 100, 333, 1000, 3000]:
        for _ in range(20):
            s = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            # As far apart as may be: elements left out, added, or both.
            apart = [(k, m) for k in range(n // 4 + 1) for m in {0, k, n // 4} if rule.den * (n - k) >= rule.num * (n + m) and k + m]
            if not apart:
                continue
            k, m = apart[rng.integers(len(apart))]
            t = np.unique(np.concatenate([rng.permutation(s)[k:], rng.integers(0, 1 << 64, m, dtype=np.uint64)]))
            assert np.intersect1d(ngram_join.tiles(s, rule), ngram_join.tiles(t, rule)).size


def plain_contaminated(text, item):
    """Whether windows of 13 words of one item cover a twentieth of a text's words."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    w, b = split(text), split(item)
    windows, hit = {tuple(b[k : k + 13]) for k in range(len(b) - 12)}, set()
    for k in range(len(w) - 12):
        if tuple(w[k : k + 13]) in windows:
            hit |= set(range(k, k + 13))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_run_drops_what_the_plain_version_drops(spark, tmp_path, monkeypatch):
    rng, rows = random.Random(5), near_copies(n=45)
    item = " ".join(f"item{k}" for k in range(30))
    fill = lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    rows += [(len(rows) + k, t, "en", "a", 1) for k, t in enumerate([fill(40) + " " + item + " " + fill(40), fill(800) + " " + item, item])]
    # One very long text and a near copy of it among the short ones.
    huge = fill(30_000)
    rows += [(len(rows), huge, "en", "b", 1), (len(rows) + 1, huge + " " + fill(50), "en", "b", 1), (None, "no id " * 5, "en", "b", 1), (None, "no id " * 5, "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}

    def watched(name, stage):
        def call(spark, docs, sf_dir):
            seen[name] = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
            return stage(spark, docs, sf_dir)

        return call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, s)) for n, s in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path))
    before, after, clean, mixed = (seen[n] for n in ("n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"))
    assert len(before) == len(rows)  # no label says that anything is toxic
    named = [r for r in before if r[0] is not None]
    assert sorted(r[0] for r in after if r[0] is not None) == plain_kept(named) and sum(r[0] is None for r in after) == 2
    assert Counter(clean) == Counter(r for r in after if not plain_contaminated(r[1], item)) and 2 <= len(after) - len(clean) <= 3
    # Each source's words come near its target: two sources and null weigh 1, 2 and 3, none more than thrice its size.
    size, taken = Counter(), Counter()
    for table, sums in ((clean, size), (mixed, taken)):
        for _, t, s in table:
            sums[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        rest, w = sum(size.values()) - sum(3 * size[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / w for s in order}
        if not (more := {s for s in order if target[s] > 3 * size[s]}):
            break
        capped |= more
    for s in order:
        assert abs(taken[s] - target[s]) <= max(len((t or "").split()) for _, t, x in clean if x == s)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(mixed) and {r["shard"] for r in got} <= set(range(40))
    assert out.columns == [*docs.columns, "shard"]


def test_every_link_is_counted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 10)
    rng, rows = random.Random(8), near_copies(n=20, most=80)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for _ in range(40):  # one group of many different near copies, and some equal ones
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(150)] = f"w{rng.randrange(400)}"
        rows.append((len(rows), " ".join(text), "en", "a", 1))
    sets, want = plain_sets([r[1] for r in rows], 3), [0] * len(rows)
    links = list(plain_links(sets, 9, 10))
    for i, j, _ in links:
        want[i] += 1
        want[j] += 1
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r["doc_id"]: r for r in ngram_join.link_counts(docs).collect()}
    assert len(got) == len(rows) and max(want) > 10
    assert [got[i]["n_links"] for i in range(len(rows))] == want
    assert {i: r["component_id"] for i, r in got.items()} == {r["doc_id"]: r["component_id"] for r in ngram_join.link(docs).collect()}
    # The table holds each pair of classes once, with its overlap.
    cls = {i: r["class_id"] for i, r in got.items()}
    pairs = {(min(cls[i], cls[j]), max(cls[i], cls[j]), both) for i, j, both in links if cls[i] != cls[j]}
    table = [tuple(r) for r in ngram_join.class_links(ngram_join.Classes(docs, ngram_join.OP4)).collect()]
    assert len(table) == len(pairs) and set(table) == pairs

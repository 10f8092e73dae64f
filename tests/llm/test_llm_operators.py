"""Each operator against a plain version, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat_format, decontaminate, line_dedup, ngram_join, quality, slot_shards, source_mix, toxicity, url_filter, vector_topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
EXTRA = "h long, size long, d long, s string, row string, cls string, n string, tiles string, y string, spans string, items string, gone string, shard string, gone_id string, virtual_slot string, key string, _gone string, _row string"


def vocabulary(n=60):
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=5, n=70):
    rng, words = random.Random(seed), vocabulary()
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = []
    for i in range(n):
        rows.append([i, "\n".join(say(rng.randint(1, 30)) for _ in range(rng.randint(1, 5)))])
    for i in range(n, n + 30):  # copies and near copies
        text = rows[rng.randrange(n)][1]
        parts = text.split(" ")
        if rng.random() < 0.7:
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append([i, " ".join(parts)])
    rows += [[900, None], [901, ""], [902, " \n\t "], [903, "one"], [904, "one two"], [905, "Two\x85\u00a0 Wörter"], [906, say(20_000)], [None, say(50)], [5, rows[5][1]], [5, rows[5][1]]]
    return [(i, t, "en", rng.choice(["a", "b", None, "\U0001f600", "\uffff"]), len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    for c in EXTRA.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit("1").cast(kind))
    return df.repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1


def test_urls(spark):
    urls = [
        None, "", "nothing", "http://", "://x.org/", "http://A.Example.ORG/es/1?x=/fr/", "https://example.org/en/12", "http://example.org/EN/1", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/de/x#y",
        "http://a.com?/fr/", "http://org/", "http://org", "ftp://a.b.net/file.zip?x", "ftp://a.b.net/zip", "http://x.net/?PHPSESSID=1", "http://a://b.com/de/", "http://a.com:80/de/", "http://ad.doubleclick.net/x", "http://Ü.org/",
    ] * 2
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, token string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.SITE_RULES + url_filter.PATTERN_RULES)).collect()}
    sites = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host, path = ("", "") if rest is None else (low(re.match(r"[^/?#]*", rest)[0]), re.match(r"[^/?#]*([^?#]*)", rest)[1])
        fits = [(len(h + p), h + p, v) for v, h, p in sites if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        # Without an index: every pattern is tried.
        hits = [r for r in url_filter.PATTERN_RULES if u and re.search(r.regex, u)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if hits else "allow"))
        assert (got[i]["pattern"] is None) == (not hits)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, url_filter.SITE_RULES)).count() == 0


def test_rules_without_a_token_are_tried_everywhere(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.net/xx"), (2, "http://a.net/y")], "page_id long, url string")
    rules = url_filter.rule_table(spark, [url_filter.pattern_rule("block", "x", "x+$"), url_filter.site_rule("allow", "b.net")])
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow"}
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)  # a larger rule set is joined by shuffle
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow"}


# 2


def test_chat(spark):
    rng = random.Random(3)
    pieces = [*chat_format.CONTROLS, *(c[0] + "\\" * k + c[1:] for c in chat_format.CONTROLS for k in (1, 2)), "<", "[", "\\", "x", "\n", "|>", "é\U0001f600", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a</s>", None]), "".join(rng.choices(pieces, k=rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(100, None, "assistant", None), (100, 1, None, ""), (None, 1, "assistant", "z"), (101, 2, "user", "b"), (101, 2, "user", "b"), (102, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece long").repartition(3)
    formatted = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[c]["round_trip"] and got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(texts[c])
        # Each control string that is left is one of the template's own.
        assert sum(texts[c].count(x) for x in chat_format.CONTROLS) == 3 * len(turns)
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0


# 3


def plain_top(rows, every, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    return sorted(want)


def found_top(df, every, *sizes):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_topk.top_k(df, df.where(f"vec_id % {every} = 0"), 5, *sizes).collect())


@pytest.mark.parametrize("block, pack", [(256, 4096), (3, 16)])
def test_top_k(spark, block, pack):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], 1) for i in range(120)]
    same = rows[7][1]
    rows += [(i, same, 1) for i in range(200, 240)] + [(300, None, 1), (None, same, 1), (350, [None] * 6, 1), (400, [float("nan")] * 6, 1), (450, [float("inf")] * 6, 1), (500, [1.0], 1), (501, [2.0], 1), (550, [], 1), (551, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int").repartition(4)
    assert found_top(df, 10, block, 256, pack) == plain_top(rows, 10)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (rng.normal(size=3) * 10.0 ** rng.integers(-3, 31)).astype(np.float32)], 1) for i in range(80)]
    rows += [(100, [1.0, 2.0, 0.5], 1), (101, [1e7, 0.0, 0.0], 1), (102, [1.0, 1.0, 1.0], 1), (103, [8e6] * 3, 1), (104, [8e6] * 3, 1), (105, [1e30] * 3, 1), (106, [-1e30, 1e30, 0.0], 1), (107, [0.0] * 3, 1), (108, [-0.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int").repartition(3)
    assert found_top(df, 1) == plain_top(rows, 1)
    three = df.where("vec_id in (100, 101, 102)")
    assert found_top(three, 1) == plain_top([r for r in rows if r[0] in (100, 101, 102)], 1)


def test_sortable_scores():
    numbers = sorted({s * (1 << k) + d for s in (1, -1) for k in (0, 7, 8, 15, 16, 63, 64, 200) for d in (-1, 0, 1)})
    assert sorted(numbers, key=vector_topk.sortable) == numbers


def test_the_scan_does_not_read_exact_vectors(spark):
    rows = spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(50)], "rid long, vec_id long, v array<double>")
    file = vector_topk.packs(rows, 16)
    assert set(file.columns) == {"n", "rids", "ids", "lo", "width", "cells", "row"}
    assert sum(len(r["cells"]) for r in file.collect()) == 100


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_topk.top_k(df, df, 5).count() == 0


# 4


def plain_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = [low(x) for x in words(text)]
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), 10**9))
    return Counter((r[0], len(s), r[0] if not s else least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets)))


def test_ngram_join(docs, none):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs).collect())
    assert got == plain_components(corpus())
    assert ngram_join.link(none).count() == 0


@pytest.mark.parametrize("block, group", [(1024, 1024), (8, 10)])
def test_ngram_join_on_a_large_group(spark, monkeypatch, block, group):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP_SETS", group)
    rng, own = random.Random(8), vocabulary(400)
    base, rows = [rng.choice(own) for _ in range(150)], []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(own)
        rows.append((None if i in (3, 4) else i, " ".join(text), "en", "a", 1))
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()) == plain_components(rows)


def test_one_of_each(docs):
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in ngram_join.one_of_each(docs).collect())
    want = Counter()
    for (i, n, c), k in plain_components(corpus()).items():
        if i is None or i == c:
            want[i] += k
    assert Counter(i for _, i in got) == want


# 5


def test_mix(docs, none):
    rows = source_mix.mix(docs).collect()
    again = source_mix.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == len(corpus())
    sizes = defaultdict(int)
    for _, t, _, s, _ in corpus():
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        if not (new := {s for s in order if target[s] > 3 * sizes[s]}):
            break
        capped |= new
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert source_mix.mix(none).count() == 0
    assert source_mix.mixed(docs).count() == sum(r["copies"] for r in rows)
    assert source_mix.mixed(docs).columns == docs.columns


def test_what_is_taken_is_what_a_plain_scan_takes(docs):
    hashed = {}
    for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("x")).collect():
        hashed[r["doc_id"], r["text"]] = (r["x"] % 2**64) >> 4
    rows = source_mix.mix(docs).collect()
    target = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    want = Counter()
    for source, (goal, size) in target.items():
        own = [(hashed[i, t], len(words(t)), i) for i, t, _, s, _ in corpus() if s == source]
        times = int(goal // size) if size else 0
        left, bar, upto = goal - times * size, 0, 0
        for h in sorted({h for h, n, _ in own if n}):
            here = sum(n for x, n, _ in own if x == h)
            if upto + here >= left:
                bar = h + 1 if left > 0 and 2 * (left - upto) >= here else h
                break
            upto += here
        for h, n, i in own:
            want[i, n, (times + (h < bar)) * n] += 1
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) == want


# 6


def plain_hits(rows, bench):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wins = defaultdict(set)
    for i, t in bench:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            wins[tuple(w[k : k + 13])].add(str(i))
    out = Counter()
    for i, t, *_ in rows:
        w, hit, items = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= own
        out[i, len(w), len(hit), ",".join(sorted(items)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_decontamination(spark, docs, none, block_words):
    rows = corpus()
    text = rows[906 - 900 + 100][1]
    bench = [(1, " ".join(words(rows[3][1])[:20])), (2, rows[12][1].upper()), (10, " ".join(words(text)[50:90])), (11, "one"), (12, None), (13, ""), (None, rows[4][1]), (14, " ".join(words(text)[60:75])), (14, " ".join(words(text)[300:320]))]
    items = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, row int")
    found = decontaminate.judged(decontaminate.find_spans(docs, items, block_words=block_words))
    got = Counter((r["row"]["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in found.collect())
    assert got == plain_hits(rows, bench)
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.clean(none, items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(rows)


# 7


def test_shards(docs, none):
    got = slot_shards.shard(docs, 4).collect()
    assert len(got) == len(corpus())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and set(places) <= set(range(4))
    assert slot_shards.shard(none, 4).count() == 0
    assert slot_shards.assign(docs, 4).columns == [*(c for c in docs.columns if c != "shard"), "shard"]


def test_cut_slots_have_gapless_positions(docs, monkeypatch):
    monkeypatch.setattr(slot_shards, "SLOTS", 8)
    monkeypatch.setattr(slot_shards, "ROWS_A_CUT", 3)
    places = defaultdict(list)
    for r in slot_shards.shard(docs, 3).collect():
        places[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def loads(rows, shards):
    load = Counter({s: 0 for s in range(shards)})
    for r in rows:
        load[r["shard"]] += r["size"]
    return load


def test_shards_are_near_equal(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400), "en", "a", 1) for i in range(6000)] + [(i, "a very common text", "en", "a", 1) for i in range(6000, 8000)]
    rows += [(None, "the same row again " * 5, "en", "b", 1)] * 4000 + [(17, "y" * 100, "en", "b", 1)] * 1000
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    path = str(tmp_path / "maps")
    got = slot_shards.shard(df, 40, path).collect()
    load = loads(got, 40)
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 40
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    # The rows follow the last of the two stored versions.
    version, slots = slot_shards.load_map(spark, path)
    assert version == 2 and slot_shards.load_map(spark, path, 1)[1] == slot_shards.first_map(40)
    assert all(slots[r["virtual_slot"]] == r["shard"] and r["map_version"] == 2 for r in got)
    out = slot_shards.assign(df.withColumn("shard", F.lit("old")), 40, path)
    assert out.columns == [*df.columns, "shard"]
    assert slot_shards.load_map(spark, path)[0] == 3
    load = Counter()
    for r in out.collect():
        load[r["shard"]] += len(r["text"]) + 16
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 40


def test_maps_are_edited_and_kept(spark, tmp_path):
    rng = random.Random(1)
    sizes = {k: rng.randint(1, 1000) for k in range(slot_shards.SLOTS)}
    one = slot_shards.rebalance(slot_shards.first_map(40), sizes, 40, 0.0)
    load = Counter()
    for k, s in one.items():
        load[s] += sizes[k]
    assert max(load.values()) - min(load.values()) <= 20
    assert sum(sizes[k] for k, s in one.items() if s != k % 40) < sum(sizes.values()) / 10
    two = slot_shards.rebalance(one, sizes, 41)
    moved = [k for k in one if one[k] != two[k]]
    assert sum(sizes[k] for k in moved) < sum(sizes.values()) / 20
    load = Counter()
    for k, s in two.items():
        load[s] += sizes[k]
    assert max(load.values()) <= 1.01 * sum(sizes.values()) / 41
    three = slot_shards.rebalance(two, sizes, 39)
    assert set(three.values()) == set(range(39))
    path = str(tmp_path / "maps")
    slot_shards.save_map(spark, path, 1, one)
    slot_shards.save_map(spark, path, 2, two)
    assert slot_shards.load_map(spark, path) == (2, two) and slot_shards.load_map(spark, path, 1) == (1, one)


# 8


def labelled(spark):
    rng, own = random.Random(4), vocabulary()
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = [rng.choice(own) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w) + "." if good else "!! ".join(x.upper() for x in w), "en", "a", 1))
        labels.append((i, int(good), int(rng.random() < 0.1)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, docs):
    rows, labels = labelled(spark)
    got = {r["doc_id"]: r for r in quality.score(rows, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    apart = [(r["score"], truth[i], r["predicted"]) for i, r in got.items() if r["held_out"]]
    assert np.mean([p == y for _, y, p in apart]) > 0.97
    assert np.mean([(s - y) ** 2 for s, y, _ in apart]) < 0.03
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert all(abs(got[r["doc_id"]]["score"] - r["score"]) < 1e-6 for r in quality.score(rows, flipped).collect())
    odd = quality.score(docs, labels.limit(0)).collect()
    assert len(odd) == len(corpus()) and {r["score"] for r in odd} == {0.5}
    assert quality.score(rows.limit(0), labels).count() == 0


def test_isotonic_is_least_squares():
    y = np.array([0.0, 1, 0, 1, 1, 0, 1])
    s, p = quality.isotonic(np.ones(7), y, np.arange(7.0))
    assert s.tolist() == [0.0, 1.5, 4.0, 6.0] and (np.diff(p) >= 0).all()


# 9


def test_lines(spark, docs, none):
    rng = random.Random(6)
    lines = ["a line of some length %d" % k for k in range(12)] + ["short", "", "  \x0b", "Ünïcode line here", "exactly10c"]
    rows = [(i, "\n".join(rng.choice([str.upper, str, lambda x: f"\t{x} \r"])(rng.choice(lines)) for _ in range(rng.randint(0, 8))), "en", "a", 1) for i in range(60)] + [(7, lines[0] + "\n" + lines[1], "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("gone", F.lit(1)).repartition(4)
    for n_batches, source in ((4, (df, rows)), (1, (df, rows)), (3, (docs, corpus()))):
        df_, rows_ = source
        keep = {}
        strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
        for i, t, *_ in rows_:
            for x in (t or "").split("\n"):
                keep[strip(x)] = min(keep.get(strip(x), 2**63), 2**63 - 1 if i is None else i)
        want = Counter()
        for i, t, *_ in rows_:
            all_ = (t or "").split("\n")
            left = [x for x in all_ if len(strip(x)) < 10 or keep[strip(x)] == (2**63 - 1 if i is None else i)]
            want[i, len(all_), len(all_) - len(left), "\n".join(left)] += 1
        got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(df_, n_batches=n_batches).collect())
        assert got == want
    assert line_dedup.dedup_lines(none).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


# 10


def test_toxicity(spark, docs):
    rng, own = random.Random(9), vocabulary(300)
    rows, labels = [], []
    for i in range(900):
        bad, junk = rng.random() < 0.15, rng.random() < 0.2
        w = [rng.choice(own) for _ in range(rng.randint(10, 80))]
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgle", "zqux" + rng.choice(own), "Vreek!"]))
        rows.append((i, " ".join(w), "en" if i % 4 else "de", "a", 1))
        labels.append((i, int(not junk), int(bad)))
    df = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, marks.where("doc_id % 3 <> 0"))
    assert chain.names == ["junk_abuse", "foreign_abuse", "toxic"] and [len(m) for m in chain.models] == [chain.width + 1 + k for k in range(3)]
    got = {r["row"]["doc_id"]: r["toxic"] for r in toxicity.score(df, chain).collect()}
    apart = [(got[i] >= toxicity.THRESHOLD, bool(t)) for i, _, t in labels if i % 3 == 0]
    assert np.mean([a == b for a, b in apart]) > 0.97
    assert not [1 for a, b in apart if a and not b]
    kept = toxicity.clean(df, marks)
    assert kept.columns == df.columns and 0 < kept.count() < 900
    assert toxicity.score(docs, chain).count() == len(corpus())
    assert toxicity.clean(docs, marks.limit(0)).count() == len(corpus())
    assert toxicity.clean(df.limit(0), marks).count() == 0


def test_the_chain_reads_earlier_categories():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    first = (x[:, 0] > 0).astype(float)
    y = np.stack([first, first], axis=1)
    chain = toxicity.Chain({b"a": 0}, ["one", "two"])
    chain.fit(x, y, np.arange(600) % 3)
    assert chain.models[1][2] > 0.1
    assert ((chain.predict(x)[1] > 0.5) == (first > 0.5)).mean() > 0.97


def plain_logistic(x, y, ridge=0.2):
    """Newton's method on all rows at once."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag(keep), x.T @ (p - y) + keep * w)
    return w


def test_the_chain_is_a_plain_chain(spark):
    rng, own = random.Random(12), vocabulary(80)
    rows, labels = [], []
    for i in range(300):
        bad, junk = rng.random() < 0.3, rng.random() < 0.4
        w = [rng.choice(own) for _ in range(rng.randint(3, 30))] + (["zorgle"] * rng.randint(0, 2) + ["zquxa"] if bad else ["zorgle"] * (rng.random() < 0.1))
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), "a", 1))
        labels.append((i, int(not junk), int(bad)))
    labels += [(5, 1, 1), (6, 0, 0), (7, 1, 1), (7, 0, 0)]  # repeated and contradicting labels: the larger counts
    rows += [rows[8], rows[8]]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, marks)
    got = {(r["row"]["doc_id"], *[round(r[c], 3) for c in chain.names]) for r in toxicity.score(df, chain).collect()}
    truth = {}
    for i, q, t in labels:
        a, b = truth.get(i, (0, 0))
        truth[i] = max(a, q), max(b, t)
    folds = {r["doc_id"]: r["f"] for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) % 3).alias("f")).collect()}
    rows.sort()

    def form(t):
        raw = t.encode()
        n = len(re.findall(rb"[a-z0-9\x80-\xff]+", raw.lower()))
        return [np.log1p(n), sum(65 <= b <= 90 for b in raw) / len(raw), sum(b in b"#$%&*@^~+=_|" for b in raw) / len(raw), sum(b >= 128 for b in raw) / len(raw)]

    def count(t, f):
        return sum(w.startswith(f[:-1]) if f.endswith(b"*") else w == f for w in t.encode().split())

    x = np.array([[np.log1p(count(t, f)) for f in chain.words] + form(t) for _, t, *_ in rows])
    y = np.array([[b and not a, b and lang != "en", b] for (i, _, lang, *_) in rows for a, b in [truth[i]]], float)
    fold, ones = np.array([folds[r[0]] for r in rows]), np.ones((len(rows), 1))
    apart, final = x, x
    p = lambda d, w: 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    logit = lambda q: np.log(np.clip(q, 1e-4, 1 - 1e-4) / (1 - np.clip(q, 1e-4, 1 - 1e-4)))[:, None]
    want = []
    for c in range(3):
        d, w = np.hstack([apart, ones]), None
        w = plain_logistic(d, y[:, c])
        out = np.zeros(len(rows))
        for f in range(3):
            out[fold == f] = p(d[fold == f], plain_logistic(d[fold != f], y[fold != f, c]))
        want.append(p(np.hstack([final, ones]), w))
        apart, final = np.hstack([apart, logit(out)]), np.hstack([final, logit(want[-1])])
    for k, r in enumerate(rows):
        assert min(max(abs(g[c + 1] - want[c][k]) for c in range(3)) for g in got if g[0] == r[0]) < 0.02


def test_quality_is_a_plain_ridge(spark):
    rows, labels = labelled(spark)
    rows = rows.unionByName(rows.where("doc_id < 5")).unionByName(rows.where("doc_id < 5"))  # repeated rows count as often
    labels = labels.unionByName(labels.where("doc_id in (1, 2)").withColumn("quality", F.lit(0)))  # of contradicting labels the smaller counts
    measured = quality.measure(rows)
    model = quality.fit(measured, labels)
    told = {r["doc_id"]: r["q"] for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).collect()}
    use = [(np.array(r["x"], np.float64), told[r["doc_id"]]) for r in measured.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    x, y = np.array([a for a, _ in use]), np.array([b for _, b in use], float)
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-6) and np.allclose(model.scale, np.sqrt(np.maximum(x.var(axis=0), 1e-8)), rtol=1e-3, atol=1e-4)
    z = model.features(x)
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + 1e-3 * len(z) / quality.FEATURES * np.eye(z.shape[1]), z.T @ y), atol=1e-5)
    # The features approximate a Gaussian kernel.
    s = np.clip((x - model.mean) / model.scale, -6, 6)[:60]
    gauss = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * x.shape[1]))
    assert np.abs(z[:60, :-1] @ z[:60, :-1].T - gauss).mean() < 0.1
    scores = quality.score(rows, labels).collect()
    assert len(scores) == rows.count()

"""Records of equal text stay in one shard unless they are too many for one."""

import random
from collections import Counter, defaultdict

from glyphmill.llm import slot_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def test_equal_texts_share_a_shard(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(50, 300) + str(i), "en", "a", 1) for i in range(5000)]
    groups = [f"group {g} " * rng.randint(3, 9) for g in range(200)]
    rows += [(10_000 + k, t, "en", "b", 1) for k, t in enumerate(t for t in groups for _ in range(rng.randint(2, 12)))]
    hot = "the text that a third of all rows have"
    rows += [(20_000 + k if k % 2 else None, hot, "en", "c", 1) for k in range(3000)]
    rows += [(30_000 + k, None if k % 2 else "", "en", "c", 1) for k in range(40)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    got, total = slot_shards.shard(df, 40).collect(), sum(len(r[1] or "") + 16 for r in rows)
    assert len(got) == len(rows)
    load, own, where, places = Counter(), Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        own[r["text_crc32"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
        places[r["shard"]].append(r["slot"])
    assert max(load.values()) - min(load.values()) <= 0.02 * total / 40
    whole = [t for t in where if own[t] * 40 <= total * slot_shards.WHOLE]
    assert all(len(where[t]) == 1 for t in whole) and len(where) - len(whole) == 1
    assert max(map(len, where.values())) >= 35  # the hot text is spread
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    # The stage of the pipeline does the same.
    kept = defaultdict(set)
    for r in slot_shards.assign(df, 40).collect():
        kept[r["text"] or ""].add(r["shard"])
    assert all(len(s) == 1 for t, s in kept.items() if t != hot) and len(kept[hot]) >= 35

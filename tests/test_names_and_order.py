"""Names in one pass, and streams whose files are out of order, against plain versions."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import names
from glyphmill.streaming import ordered, sampler

SMALL = "/root/testdata/sf0.001"


def plain_names(text, rules):
    out, at, changed = "", 0, 0
    while at < len(text):
        fits = [(len(a), a, n) for a, n, t in rules if text.startswith(a, at) and not (t and text.startswith(t, at + len(a)))]
        if not fits:
            out, at = out + text[at], at + 1
            continue
        size, literal, name = max(fits, key=lambda x: x[0])
        out, at, changed = out + name, at + size, changed + (literal != name)
    return out, changed


def test_full_names(spark):
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("ab遮那王\U0001f600") for _ in range(n))
    literals = sorted({say(rng.randint(1, 4)) for _ in range(30)})
    rules = [(a, rng.choice([a + say(1), a, "", say(3)]), rng.choice(["", None, say(1)])) for a in literals]
    told = [(a, n, (n[len(a) :] if n.startswith(a) else "") if t is None else t) for a, n, t in rules]
    texts = [say(rng.randint(0, 60)) for _ in range(120)] + [None, "", "遮那王遮那"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own = spark.createDataFrame([*rules, *rules[:3], ("", "x", None), (None, "x", None)], "literal string, name string, tail string")
    got = {r["doc_id"]: (r["text"], r["changed"]) for r in names.full_names(df, own).collect()}
    assert got == {k: (None, None) if t is None else plain_names(t, told) for k, t in enumerate(texts)}
    one = spark.createDataFrame([("遮那", "遮那王", None), ("義経", "遮那王", None)], "literal string, name string, tail string")
    assert names.full_names(spark.createDataFrame([("遮那は遮那王と義経",)], "text string"), one).collect()[0]["text"] == "遮那王は遮那王と遮那王"
    assert [r["text"] for r in names.full_names(df, own.limit(0)).orderBy("doc_id").collect()] == texts


def test_ten_thousand_names_take_one_pass():
    rng = random.Random(2)
    say = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9)))
    few, many = (names.Names([(x, x.title(), "") for x in {say() for _ in range(n)}]) for n in (100, 10_000))
    text = " ".join(say() for _ in range(20_000))
    took = []
    for trie in (few, many):
        began = time.perf_counter()
        trie.replace(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_more_names_than_allowed_are_refused(spark, monkeypatch):
    monkeypatch.setattr(names, "MOST", 1)
    rules = spark.createDataFrame([("a", "b", None), ("c", "d", None)], "literal string, name string, tail string")
    with pytest.raises(ValueError, match="more than 1 names"):
        names.full_names(spark.createDataFrame([("a",)], "text string"), rules)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_streams_out_of_order(spark):
    stream = ordered.overlapping_files(spark, SMALL)
    assert stream.isStreaming
    folder = sampler.run_now(stream.select("event_id", "ts"), "append")
    seen = [r["ts"] for r in folder.orderBy("batch").collect()]
    assert len({r["batch"] for r in folder.collect()}) == ordered.FILES and seen != sorted(seen)
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("user_id", "ts", "event_id").collect()
    want, last = {}, {}
    for r in events:
        before = last.get(r["user_id"])
        want[r["event_id"]] = None if before is None or r["value"] is None else round(r["value"] - before, 6)
        last[r["user_id"]] = r["value"]
    got = {r["event_id"]: r["delta"] for r in ordered.deltas(spark, SMALL).collect()}
    assert 0 < len(got) < len(want) and got == {k: pytest.approx(want[k]) if want[k] is not None else None for k in got}
    # What waits is later than everything that went out.
    at = {r["event_id"]: r["ts"] for r in events}
    assert max(at[k] for k in got) < min(at[k] for k in want if k not in got)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_batches_do_not_grow_with_files(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        written = ordered.spans(spark, str(tmp_path))
        folder = sampler.run_now(ordered.folders(spark, str(tmp_path), written).select("event_id"), "append")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert written[1] == 3 and len(list(Path(written[0].removeprefix("file:")).glob("file=*/*.parquet"))) == 3 * ordered.FILES
    assert folder.select("batch").distinct().count() == ordered.FILES and folder.count() == events.count()

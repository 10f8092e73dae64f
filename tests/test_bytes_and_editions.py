"""Byte streams of mixed widths, archives in archives, members that are replaced together, numbers within keys."""

import os
import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import resolve
from glyphmill.sources import archives, nested, publish, streams

WIDTHS = streams.Widths(dropped={0x1B: 1, 0x1C: 0, 0x1D: 3}, controls={0x00: 0, 0x02: 4, 0x04: 2})


def plain_runs(data: bytes, w: streams.Widths):
    """(place, text, control, operands, cut) by a walk from unit to unit."""
    out, i, at, text = [], 0, 0, b""

    def width(b):
        return next((n for a, z, n in w.leads if a <= b <= z), 1)

    while i < len(data):
        b = data[i]
        n = 1 + w.dropped[b] if b in w.dropped else 1 + w.controls[b] if b in w.controls else width(b)
        if i + n > len(data):
            out.append((at, text, data[i : i + 1], data[i + 1 :], True))
            return out
        if b in w.controls:
            out.append((at, text, data[i : i + 1], data[i + 1 : i + n], False))
            at, text = i + n, b""
        elif b not in w.dropped:
            text += data[i : i + n]
        i += n
    if at < len(data):
        out.append((at, text, None, None, False))
    return out


def test_mixed_widths(spark):
    rng = random.Random(4)
    units = [0x00, 0x02, 0x04, 0x1B, 0x1C, 0x1D, 0x0A, 0x41, 0x5C, 0x81, 0x9F, 0xA5, 0xE0, 0xFC, 0xFF]
    rows = [(f"r{k}", bytes(rng.choice(units) if rng.random() < 0.7 else rng.randrange(256) for _ in range(rng.randint(0, 40)))) for k in range(400)]
    rows += [("long", bytes(rng.choice(units) for _ in range(60_000))), ("text", b"\x83\x5c" * 30_000), ("empty", b""), ("null", None), ("cut", b"ab\x02\x01"), ("lead", b"ab\x81")]
    got = defaultdict(list)
    for r in streams.mixed_width(spark.createDataFrame(rows, "path string, content binary").repartition(3), WIDTHS).collect():
        b = lambda x: None if x is None else bytes(x)
        got[r["path"]].append((r["seq"], r["place"], b(r["text"]), b(r["control"]), b(r["operands"]), r["error"] is not None))
    for path, data in rows:
        assert [x[1:] for x in sorted(got[path])] == plain_runs(data or b"", WIDTHS), path
    # A second byte that looks like a control isn't one.
    one = streams.mixed_width(spark.createDataFrame([("a", b"\x83\x02x\x04\x00\x00y")], "path string, content binary"), WIDTHS).orderBy("seq").collect()
    assert [bytes(r["text"]) for r in one] == [b"\x83\x02x", b"y"] and bytes(one[0]["operands"]) == b"\0\0"


def test_mixed_widths_stay_in_their_row(spark):
    # Streams of one key each have their own places, and nothing is shuffled.
    rows = streams.mixed_width(spark.createDataFrame([("a", b"xy\x00z"), ("a", b"\x1bq\x00" + 70_000 * b"w" + b"\x00v")], "path string, content binary"), streams.Widths())
    assert sorted((r["seq"], r["place"], len(r["text"])) for r in rows.collect()) == [(0, 0, 0), (0, 0, 2), (1, 3, 1), (1, 3, 70_000), (2, 70_004, 1)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def packed(members, magic=b"ARC0"):
    head, body, at = magic + struct.pack("<I", len(members)), b"", 8 + 40 * len(members)
    for name, data in members:
        head += name.encode().ljust(32, b"\0") + struct.pack("<II", at + len(body), len(data))
        body += data
    return head + body


def test_archives_in_archives(spark):
    layouts = [("41524330", archives.LAYOUTS["name-offset-size"]), ("41524331", archives.ArchiveLayout(4, 32, "nos"))]
    level = packed([("leaf", b"deepest"), ("empty", b"")])
    for k in range(4):
        level = packed([("note", b"%d" % k), ("inner", level)], b"ARC1" if k % 2 else b"ARC0")
    # An archive whose member reaches over all of it holds itself.
    own = bytearray(packed([("me", b"")]))
    own[8 + 32 : 8 + 40] = struct.pack("<II", 0, len(own))
    short = packed([("there", b"abc"), ("cut", b"0123456789")])[:-4]
    rows = [("deep", level), ("self", bytes(own)), ("short", short), ("plain", b"no archive"), ("none", packed([])), ("null", None), ("twice", packed([("a", b"1"), ("a", b"1")]))]
    got = sorted((r["path"], r["name"], r["depth"], bytes(r["data"] or b""), r["error"]) for r in nested.descend(spark.createDataFrame(rows, "path string, content binary"), layouts).collect())
    inner = "deep" + "!inner" * 4
    want = [("deep" + "!inner" * k, "note", k + 1, b"%d" % (3 - k), None) for k in range(4)] + [(inner, "leaf", 5, b"deepest", None), (inner, "empty", 5, b"", None)]
    want += [("self", "me", 1, bytes(own), "holds itself"), ("short", "there", 1, b"abc", None), ("short", "cut", 1, b"012345", "member reaches past the end"), ("twice", "a", 1, b"1", None), ("twice", "a", 1, b"1", None)]
    assert got == sorted(want)


def members(spark, rows):
    return spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in rows], "name string, data binary")


def held(df):
    return {r["name"]: None if r["data"] is None else bytes(r["data"]) for r in df.collect()}


def test_members_are_replaced_together(spark, tmp_path):
    path = str(tmp_path / "work")
    assert publish.current(spark, path) == 0 and held(publish.read_members(spark, path)) == {}
    first = [("a", b"\x00\xff"), ("b", b"text"), ("c", None)]
    assert publish.publish(members(spark, first), path, dry_run=True) == publish.Edition(0, 3, 0, 0, 0)
    assert publish.current(spark, path) == 0
    assert publish.publish(members(spark, first), path) == publish.Edition(1, 3, 0, 0, 0)
    assert held(publish.read_members(spark, path)) == dict(first)
    assert publish.publish(members(spark, first), path) == publish.Edition(1, 0, 0, 3, 0)  # nothing new
    second = [("a", b"\x00\xff"), ("b", b"other"), ("d", b"")]
    gone = lambda old, new: old.join(new, "name", "left_anti").select("name")
    for wrong, verify in ((second, gone), ([("a", b"1"), ("a", b"2")], None), ([(None, b"1")], None)):
        with pytest.raises(publish.Rejected):
            publish.publish(members(spark, wrong), path, verify)
        assert held(publish.read_members(spark, path)) == dict(first) and publish.current(spark, path) == 1
    failing = members(spark, second).withColumn("data", F.when(F.col("name") == "d", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        publish.publish(failing, path)
    assert held(publish.read_members(spark, path)) == dict(first)
    assert publish.publish(members(spark, second), path) == publish.Edition(2, 1, 1, 1, 1)
    assert held(publish.read_members(spark, path)) == dict(second) and held(publish.read_members(spark, path, 1)) == dict(first)
    publish.back_to(spark, path, 1)
    assert held(publish.read_members(spark, path)) == dict(first)
    assert publish.publish(members(spark, [("z", b"1")]), path) == publish.Edition(3, 1, 0, 0, 3)
    assert held(publish.read_members(spark, path, 2)) == dict(second)
    assert not [x for x in os.listdir(path) if x.startswith(("_staged", "next"))]


def test_numbers_within_keys(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"k{rng.randrange(50)}", i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, n long, _keep string").repartition(6)
    got = resolve.numbered_within(df, ["key"], [F.col("n")], "place")
    assert got.columns == ["key", "n", "_keep", "place"]
    places = defaultdict(list)
    for r in got.collect():
        places[r["key"]].append((r["n"], r["place"]))
    assert sum(map(len, places.values())) == len(rows)
    for own in places.values():
        assert [p for _, p in sorted(own)] == list(range(1, len(own) + 1))


def test_slot_values_follow_the_last_set(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), i, rng.choice(["set", "append", "append", "print"]), rng.choice(["s", None]), rng.choice(["x", "yy", "", None])) for i in range(600)]
    want, state = {}, {}
    for k, i, op, slot, text in rows:
        if op == "set":
            state[k, slot] = [] if text is None else [text]
        elif op == "append" and text is not None:
            state.setdefault((k, slot), []).append(text)
        elif op == "print":
            want[i] = "".join(state[k, slot]) if state.get((k, slot)) else None
    got = resolve.slot_values(spark.createDataFrame(rows, "k string, pos long, op string, slot string, text string"), "k", "pos")
    assert {r["pos"]: r["value"] for r in got.collect()} == want and got.columns == ["k", "pos", "op", "slot", "text", "value"]

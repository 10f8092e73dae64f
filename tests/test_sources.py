import gzip
import lzma
import struct
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from glyphmill.functions import codecs, lexers
from glyphmill.sources import archives, identify, sinks


def blob(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_decompress(spark):
    text = b"the same and the same and the same again" * 5
    raw = zlib.compress(text)[2:-4]
    rows = [("zlib", zlib.compress(text)), ("deflate", raw), ("gzip", gzip.compress(text)), ("lzma", lzma.compress(text)), ("zstd", zstandard.compress(text)), ("", text), ("lz4", bytes([0x54]) + b"hello" + struct.pack("<H", 5) + bytes([0x10]) + b"!"), ("zlib", b"junk"), ("none", b"x")]
    df = spark.createDataFrame([(i, c, bytearray(b)) for i, (c, b) in enumerate(rows)], "i int, c string, b binary")
    got = {r["i"]: r["d"] for r in df.select("i", codecs.decompress("b", "c").alias("d")).collect()}
    assert all(bytes(got[i]["data"]) == text and got[i]["error"] is None for i in range(6))
    assert bytes(got[6]["data"]) == b"hello" + b"hellohel" + b"!"
    assert got[7]["data"] is None and got[7]["error"] and "unknown codec" in got[8]["error"]


def test_lzss_ring():
    # Three literals, then a match of three at the place where they were written.
    start = 4096 - 18
    assert codecs.lzss(bytes([0b0111]) + b"abc" + bytes([start & 255, (start >> 8) << 4 | 0])) == b"abcabc"
    with pytest.raises(ValueError):
        codecs.lzss(b"\x00\x01")


def test_text_decoding(spark):
    rows = ["あい".encode("cp932"), "﻿a".encode(), "abあ".encode("utf-16"), "plain".encode("utf-16-le"), "あ".encode(), b"\x81"]
    got = [r["t"] for r in blob(spark, *rows).select(codecs.decode_text("content", F.lit(None).cast("string")).alias("t")).collect()]
    assert [t["text"] for t in got] == ["あい", "a", "abあ", "plain", "あ", None]
    assert got[5]["error"] and [t["encoding"] for t in got[:5]] == ["cp932", "utf-8-sig", "utf-16", "utf-16-le", "utf-8"]


def test_byte_functions(spark):
    df = blob(spark, bytes(range(256)), b"aaaa", b"aabb", b"")
    assert [round(r[0], 6) for r in df.select(codecs.byte_entropy(F.col("content"))).collect()] == [8.0, 0.0, 1.0, 0.0]
    twice = codecs.translate_bytes(codecs.rotate_table(6))(codecs.translate_bytes(codecs.rotate_table(2))("content"))
    assert bytes(df.select(twice).first()[0]) == bytes(range(256))
    assert codecs.nibble_table()[0x12] == 0x21 and codecs.xor_table(0x84)[0x84] == 0
    one = spark.createDataFrame([([0, 2, 9], "abc", "ｶﾞ")], "c array<int>, t string, k string")
    assert tuple(one.select(codecs.decode_table("c", "t"), codecs.normalise("k", F.lit("NFKC"))).first()) == ("ac<0009>", "ガ")


def test_tags_nest_and_end_with_their_line(spark):
    df = spark.createDataFrame([(1, 'Hi[name v="ab" w=[x]]there[l][broken [r]x\n[open\ny]z')], "i int, text string")
    got = df.lateralJoin(lexers.TagTokens(F.col("text").outer())).orderBy("pos").collect()
    assert [(r["kind"], r["name"]) for r in got] == [("text", None), ("tag", "name"), ("text", None), ("tag", "l"), ("tag", "broken"), ("text", None), ("cut", "open"), ("text", None)]
    assert got[1]["attributes"]["v"] == "ab" and got[2]["value"] == "there" and got[5]["value"] == "x" and got[7]["value"] == "y]z"


def test_line_scripts(spark):
    df = spark.createDataFrame([("*start\n; note\nbg 1\nあ@い\\\n\n",)], "text string")
    got = [(r["kind"], r["value"]) for r in df.lateralJoin(lexers.LineScript(F.col("text").outer())).orderBy("pos").collect()]
    assert got == [("label", "start"), ("command", "bg 1"), ("text", "あ"), ("@", ""), ("text", "い"), ("\\", "")]


def test_opcode_walk(spark):
    df = blob(spark, bytes([1, 5, 2]) + b"hey\0" + bytes([3]), bytes([1]))
    got = df.lateralJoin(lexers.OpcodeWalk(F.col("content").outer(), F.lit("01:b 02:s"))).orderBy("path", "off").collect()
    assert [(r["off"], r["op"], r["operands"], r["error"]) for r in got] == [(0, 1, ["5"], None), (2, 2, ["hey"], None), (7, 3, None, "unknown opcode"), (0, 1, None, "cut operand")]


def test_printable_runs(spark):
    df = blob(spark, b"\x00\x01hello\x00" + "あいう".encode("cp932"))
    got = {(r["encoding"], r["text"]) for r in df.lateralJoin(lexers.PrintableRuns(F.col("content").outer(), F.lit(3))).collect()}
    assert ("ascii", "hello") in got and ("cp932", "あいう") in got


def archive(order, members_, compress=False):
    head = b"ARC1" + struct.pack(order + "I", len(members_))
    width, body, table = 16, b"", b""
    base = len(head) + len(members_) * (width + (12 if compress else 8))
    for name, data in members_:
        stored = zlib.compress(data) if compress else data
        table += struct.pack(f"{order}{width}sII", name.encode(), base + len(body), len(stored)) + (struct.pack(order + "I", len(data)) if compress else b"")
        body += stored
    return head + table + body


def test_archives(spark):
    own = [("one.txt", b"first"), ("two.txt", b"second member"), ("none", b"")]
    layout = archives.ArchiveLayout(4, 16, "nosr", "<", "zlib")
    files = blob(spark, archive("<", own, True), archive("<", own, True)[:-3], b"")
    got = {(r["path"], r["name"]): r for r in archives.extract(files, layout).collect()}
    assert {k[1]: bytes(v["data"]) for k, v in got.items() if k[0] == "f0"} == dict(own)
    assert got["f1", "none"]["error"] and got["f1", "one.txt"]["error"] is None and len(got) == 6
    rows = archives.members(files, layout).where("path = 'f0'").orderBy("id").collect()
    assert [r["name"] for r in rows][:2] == ["one.txt", "two.txt"] and [r["raw"] for r in rows] == [5, 13, 0]


def test_offsets_records_sectors(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 1, 2048), ("a", 2, 1)], "path string, id int, stored long")
    assert [r["off"] for r in archives.aligned_offsets(rows, 2048).orderBy("id").collect()] == [0, 2048, 4096]
    got = archives.records(blob(spark, b"aaabbbbccd"), 7, {"head": (0, 3), "body": (3, 4)}).collect()
    assert [(r["record"], bytes(r["head"]), bytes(r["body"])) for r in got] == [(0, b"aaa", b"bbbb")]
    sector = lambda mode, fill: b"\0" * 15 + bytes([mode]) + (b"\1" * 8 if mode == 2 else b"") + fill * 2048 + b"\2" * (280 if mode == 2 else 288)
    got = archives.raw_sectors(blob(spark, sector(1, b"x") + sector(2, b"y"))).orderBy("record").collect()
    assert [bytes(r["data"]) for r in got] == [b"x" * 2048, b"y" * 2048]
    parts = spark.createDataFrame([("m", 1, bytearray(b"cd")), ("m", 0, bytearray(b"ab"))], "name string, pos int, data binary")
    assert bytes(archives.join_segments(parts, ["name"]).first()["data"]) == b"abcd"


def test_identify(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "b.bin").write_bytes(b"\0\0\0CRILAYLA...")
    (tmp_path / "c.bin").write_bytes(b"\0" * 0x8001 + b"CD001")
    (tmp_path / "d.txt").write_bytes(b"?")
    files = identify.scan_files(spark, str(tmp_path))
    got = {r["path"][-5:]: (r["kind"], r["codec"]) for r in identify.identify(files).collect()}
    assert got == {"a.zip": ("zip", "deflate"), "b.bin": ("crilayla data", "crilayla"), "c.bin": ("iso9660", ""), "d.txt": (None, None)}
    assert [(r["kind"], r["offset"]) for r in identify.all_signatures(files.where("path like '%b.bin'")).collect()] == [("crilayla data", 3)]
    assert [(r["ext"], r["files"]) for r in identify.extension_stats(files).collect()] == [("bin", 2), ("txt", 1), ("zip", 1)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, " "), (4, "c")], "line_no int, line string")
    assert sinks.write_marked_text(rows, str(tmp_path / "x.txt"), ["line_no"], blanks=False) == 3
    assert (tmp_path / "x.txt").read_bytes() == b"\xef\xbb\xbfa\nb\nc\n"
    sinks.write_lines(rows, str(tmp_path / "lines"), ["line_no"])
    assert [x for p in sorted((tmp_path / "lines").glob("part-*")) for x in p.read_text().splitlines()] == ["a", "b", " ", "c"]
    sinks.write_evidence(rows, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 4
    old = spark.createDataFrame([(1, "x")], "line_no int, line string")
    assert sinks.append_missing(rows, old, ["line_no"]).count() == 4

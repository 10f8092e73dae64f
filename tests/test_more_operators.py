import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import dedupe, graph, ledger, lines, repair, reports, resolve, similarity
from glyphmill.sources import identify, readers, sinks


def rows_of(spark, docs):
    return lines.lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))


def plain_fold(text, most=120):
    keep, at = [], 0
    while at < len(text):
        sizes = [k for k in range(1, most + 1) if at + 2 * k <= len(text) and text[at : at + k] == text[at + k : at + 2 * k]]
        keep += range(at, at + max(sizes, default=1))
        at += 2 * max(sizes) if sizes else 1
    return keep


def test_folded_blocks(spark):
    rng = random.Random(4)
    texts = ["ababc", "aaab", "abcabcabc", "abc", "a"] + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(40)] + ["".join(rng.choice("abc") for _ in range(30)) * 3]
    for most in (120, 4):
        got = {k: [] for k in range(len(texts))}
        for r in dedupe.folded(rows_of(spark, ["\n".join(t) for t in texts]), most).collect():
            got[r["doc_id"]].append(r["line_no"] - 1)
        assert {k: sorted(v) for k, v in got.items()} == {k: plain_fold(t, most) for k, t in enumerate(texts)}


def plain_drop(lines, least):
    keep, i = [], 0
    while i < len(lines):
        best = 0
        for j in range(i):
            k = 0
            while i + k < len(lines) and j + k < i and lines[i + k] == lines[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            i += best
        else:
            keep.append(i)
            i += 1
    return keep


def test_earlier_repeats():
    assert dedupe.drop_earlier_repeats(list("abcdexabcdey"), 5) == [0, 1, 2, 3, 4, 5, 11]
    assert dedupe.drop_earlier_repeats(list("abcdxabcdy"), 5) == list(range(10))
    rng = random.Random(5)
    for _ in range(200):
        text = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        assert dedupe.drop_earlier_repeats(text, 3) == plain_drop(text, 3)


def test_blocks_by_document_and_common_blocks(spark):
    rows = rows_of(spark, ["a\nb\nc\na\nb\nc\nd", "x\ny\nz\nq", "x\ny\nz", "p\nx\ny\nz"])
    assert sorted(r["line_no"] for r in dedupe.by_document(rows, lambda x: dedupe.drop_earlier_repeats(x, 3)).where("doc_id = 0").collect()) == [1, 2, 3, 7]
    assert sorted(tuple(r) for r in dedupe.common_blocks(rows, 3, 3).collect()) == [(2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (3, 4)]
    assert dedupe.common_blocks(rows, 3, 4).count() == 0


def test_macro_twins(spark):
    rows = rows_of(spark, ["Hi @n\nHi Bob\nother\nHi Bob"])
    got = dedupe.prefer_macro_twins(rows, F.replace("line", F.lit("@n"), F.lit("Bob")))
    assert [r["line_no"] for r in got.orderBy("line_no").collect()] == [1, 3, 4]


def test_periods(spark):
    df = spark.createDataFrame([(list("abab"),), (list("aba"),), (list("aaa"),), (list("abc"),), ([],)], "a array<string>")
    assert [r[0] for r in df.select(dedupe.smallest_period(F.col("a"))).collect()] == [2, 2, 1, 3, 0]


def test_splits(spark):
    one = spark.createDataFrame([("「a」　「b」", "「a」x「b」", "「a」")], "a string, b string, c string")
    row = one.select(repair.split_speech(F.col("a")), repair.split_boxes(F.col("a")), repair.split_boxes(F.col("b")), repair.split_boxes(F.col("c"))).first()
    assert list(row) == [["「a」", "「b」"], ["「a」", "「b」"], ["「a」x「b」"], ["「a」"]]


def test_join_wrapped_keeps_characters(spark):
    rows = rows_of(spark, ["「a\nb」\nc\n「d\ne\nf\ng\nh」\n「open"])
    got = repair.join_wrapped(rows)
    assert [(r["line"], r["parts"]) for r in got.orderBy("line_no").collect()] == [("「ab」", 2), ("c", 1), ("「defgh」", 5), ("「open", 1)]
    assert repair.kept_characters(rows, got).count() == 0
    assert repair.kept_characters(rows, got.where("line_no > 1")).count() == 1


def test_near_same(spark):
    cases = [("the quick brown fox", "the quick brown fax"), ("abc", "xyz"), (None, "a"), ("same text", "same text"), ("abcde", "abcdf"), ("aaaa" * 3, "aaaa" * 3 + "a very long rest")]
    df = spark.createDataFrame(cases, "a string, b string")
    assert [tuple(r) for r in df.select(repair.near_same(F.col("a"), F.col("b")), repair.affix_cover(F.col("a"), F.col("b"))).collect()] == [(True, True), (False, False), (None, None), (True, False), (False, True), (False, False)]


def plain_clicks(s, clicks):
    out, held, i = [], "", 0
    while i < len(s):
        if s[i] == "_" and s[i + 1 : i + 2] and s[i + 1] in clicks:
            held, i = held + s[i + 1], i + 2
            continue
        held, last, i = held + s[i], s[i], i + 1
        if last in clicks:
            while i < len(s) and s[i] in clicks:
                held, i = held + s[i], i + 1
            out, held = [*out, held], ""
    return [*out, held] if held else out or [s]


def test_rows_are_balanced_and_cut(spark):
    rows = ["「a", "a」", "「a」」", "x。y。zz」", "a」b", "「「a", "「a」", "", "plain"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, c string").orderBy("i").select(repair.balanced(F.col("c"))).collect()]
    assert got == [["「a」"], ["a"], ["「a」"], ["x。y。", "「zz」"], ["ab"], ["「「a"], ["「a」"], [""], ["plain"]]
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab_。！」") for _ in range(rng.randint(0, 12))) for _ in range(150)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string").orderBy("i").select(repair.split_clicks(F.col("c"), "。！」")).collect()]
    assert got == [plain_clicks(x, "。！」") for x in texts]
    quotes = ["「abcdef」「abcdeg」", "「abc」「xyz」", "「a」x「b」", "x「a」「b」", "「one」"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(quotes)], "i int, c string").orderBy("i").select(repair.adjacent_quotes(F.col("c"))).collect()]
    assert got == [["「abcdef」"], ["「abc」", "「xyz」"], ["「a」x「b」"], ["x「a」「b」"], ["「one」"]]


def test_references_and_macros(spark):
    rows = spark.createDataFrame([(1, "hi {a} and {b} {a}"), (2, "none"), (3, None)], "k int, text string")
    values = spark.createDataFrame([("a", "X")], "name string, value string")
    got = {r["k"]: (r["text"], r["unresolved"]) for r in resolve.fill_references(rows, values, ["k"], "text").collect()}
    assert got == {1: ("hi X and {b} X", ["b"]), 2: ("none", []), 3: (None, [])}
    macros = spark.createDataFrame([("p", "[w]-[x]-[w]"), ("w", "wait [t]"), ("t", "tick"), ("x", "[none]"), ("a", "[b]"), ("b", "[a][t]")], "name string, body string")
    assert {r["name"]: r["body"] for r in resolve.expand_macros(macros).collect()} == {"p": "wait tick-[none]-wait tick", "w": "wait tick", "t": "tick", "x": "[none]", "a": "[b]", "b": "[a]tick"}


def test_small_text_operators(spark):
    one = spark.createDataFrame([("a\\nb\\\\nc\\q\\", "春「あ」", "あ「い」う", "ﾊﾟｯ｡")], "e string, n string, m string, k string")
    row = one.select(
        T.unescape(F.col("e"), {"n": "\n", "\\": "\\"}), T.split_name(F.col("n")), T.split_name(F.col("m")), T.full_width_kana(F.col("k")), T.looks_like_name(F.lit("春子")), T.looks_like_name(F.lit("a")), T.looks_like_name(F.lit("")),
        T.quoted(F.lit("x"), F.lit("voice"), {"voice": ("「", "」"), "mind": ("（", "）")}), T.quoted(F.lit("「x」"), F.lit("voice"), {"voice": ("「", "」")}), T.quoted(F.lit("x"), F.lit("other"), {"voice": ("「", "」")}),
    ).first()
    assert row[0] == "a\nb\\nc\\q\\" and tuple(row[1]) == ("春", "「あ」") and tuple(row[2]) == (None, "あ「い」う") and row[3] == "ハ゜ッ。"
    assert list(row[4:]) == [True, False, False, "「x」", "「x」", "x"]


def test_bytes_and_files(spark):
    files = spark.createDataFrame([("p", bytearray(b"abab\xffabab"), "2024-01-02"), ("q", bytearray(b""), "2023-01-01")], "path string, content binary, modificationTime string").withColumn("modificationTime", F.col("modificationTime").cast("timestamp"))
    assert sorted((r["byte"], r["n"]) for r in ledger.byte_histogram(files, "path").collect()) == [(97, 4), (98, 4), (255, 1)]
    assert sorted(tuple(r) for r in identify.find_all(files, "6162").collect()) == [("p", 0), ("p", 2), ("p", 5), ("p", 7)]
    assert [r["offset"] for r in identify.find_all(files.where("path = 'p'"), "616261").orderBy("offset").collect()] == [0, 5]
    assert [r["path"] for r in identify.modified_since(files, "2024-01-01").collect()] == ["p"]
    assert [r["path"] for r in identify.without_names(files, spark.createDataFrame([("P",)], "name string"), "path").collect()] == ["q"]
    runs = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert [tuple(r) for r in identify.most_runs(runs, 1).collect()] == [("b", 2)]
    segs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "doc_id long, page long")
    rows = spark.createDataFrame([(1,)] * 4 + [(2,)] * 2 + [(3,)], "doc_id long")
    assert sorted(tuple(r) for r in ledger.row_closure(segs, rows).collect()) == [(2, 1, 2), (3, 0, 1)]
    assert sorted(tuple(r) for r in ledger.row_closure(segs, rows, spark.createDataFrame([(2,), (3,)], "doc_id long")).collect()) == []


def test_marked_text_keeps_rows_and_a_backup(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "n int, line string")
    path = str(tmp_path / "out.txt")
    assert sinks.write_marked_text(rows, path, ["n"]) == 4
    assert sinks.write_marked_text(rows, path, ["n"], blanks=False) == 2
    assert (tmp_path / "out.txt").read_bytes() == b"\xef\xbb\xbfa\nb\n" and (tmp_path / "out.txt.bak").read_bytes() == b"\xef\xbb\xbfa\n\n\nb\n"
    members = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 1, "c")], "name string, line_no int, line string")
    sinks.write_members(members, str(tmp_path / "members"))
    assert spark.read.text(str(tmp_path / "members/name=x")).count() == 2


def test_slots(spark):
    ops = [("set", "a"), ("append", "b"), ("print", None), ("set", "c"), ("print", None)]
    events = spark.createDataFrame([(1, i, o, "s", t) for i, (o, t) in enumerate(ops)] + [(2, 0, "print", "s", None)], "k int, pos int, op string, slot string, text string")
    assert sorted((r["k"], r["pos"], r["value"]) for r in resolve.slot_values(events, "k", "pos").where("value is not null").collect()) == [(1, 2, "ab"), (1, 4, "c")]


def test_orders(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("z", 1)], "file string, pos int")
    assert sorted((r["number"], r["file"], r["pos"]) for r in resolve.running_numbers(rows, "file", "pos").collect()) == [(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "z", 1)]
    listed = resolve.in_listed_order(rows, spark.createDataFrame([("z", 0)], "file string, rank int"), "file")
    assert listed.orderBy("rank", "file").first()["file"] == "z"
    blocks = rows_of(spark, ["x\n*app\ny\n*main\nz"])
    label = F.when(F.col("line").startswith("*"), F.col("line"))
    assert [r["line"] for r in resolve.labelled_blocks_last(blocks, label, ["*app"]).orderBy("line_no").collect()] == ["x", "*main", "z", "*app", "y"]


def test_trailing_blocks_are_replaced_once(spark):
    rows = rows_of(spark, ["a\n【t】old\nb\n【t】old"])
    fresh = spark.createDataFrame([(0, 1, "【t】new")], "doc_id long, line_no long, line string")
    mark = F.col("line").startswith("【")
    once = resolve.replace_trailing(rows, fresh, mark)
    assert [r["line"] for r in once.orderBy("line_no").collect()] == ["a", "【t】old", "b", "【t】new"]
    assert resolve.same_rows(once, resolve.replace_trailing(once, fresh, mark))


def test_greedy_sentences(spark):
    got = resolve.greedy_sentences(rows_of(spark, ["ab\ncd.\nef\ngh"]), 100)
    assert [(r["line_no"], r["line"]) for r in got.orderBy("line_no").collect()] == [(1, "abcd."), (3, "efgh")]


def test_reports(spark):
    text = "---\n行数: 12\nTitle: One\ntitle: Two\n---\nlayout: dual\nLayout： single\n"
    row = spark.createDataFrame([(text,)], "t string").select(reports.front_matter(F.col("t")), reports.declared_layouts(F.col("t"))).first()
    assert row[0] == {"rows": "12", "title": "One"} and row[1] == ["dual", "single"]
    docs = spark.createDataFrame([("a.md", "# T\n```\n# no\n[x](gone.md)\n```\n# T\n[x](b.md#u) [y](c.md) [z](#t-1) [w](#t-2) [h](http://x)"), ("b.md", "## U\n")], "doc_id string, text string")
    assert [(r["doc_id"], r["anchor"]) for r in reports.headings(docs).orderBy("doc_id", "line_no").collect()] == [("a.md", "t"), ("a.md", "t-1"), ("b.md", "u")]
    assert sorted((r["target"], r["anchor"]) for r in reports.broken_links(docs).na.fill("").collect()) == [("a.md", "t-2"), ("c.md", "")]
    names = reports.infer_names(spark.createDataFrame([(1, "hero: Ann\nAnn and Bob. Ann. name Bob")], "doc_id int, text string"), [r"hero: (\w+)", r"name (\w+)"])
    assert tuple(names.first()) == (1, "Ann", 3)
    found = reports.option_findings(spark.createDataFrame([(1, "layout: single"), (2, "")], "doc_id int, text string"), "dual", True, spark.createDataFrame([(2,)], "doc_id int"))
    assert {tuple(r) for r in found.collect()} == {(1, "Q28_layout_mismatch", "E"), (1, "Q27_dual_without_candidates", "W"), (2, "Q28_layout_missing", "E")}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,テキスト\n1,\"あ\nい\"\n".encode("utf-8-sig"))
    assert readers.read_table(spark, str(tmp_path / "a.csv")).first()[1] == "あ\nい"
    (tmp_path / "a.json").write_text('[{"code": 401, "p": ["x"]}]')
    assert readers.read_json_documents(spark, str(tmp_path / "a.json")).first()["code"] == 401
    (tmp_path / "a.xml").write_text("<r><line n='1'>hi</line><line n='2'>ho</line></r>")
    assert readers.read_xml_rows(spark, str(tmp_path / "a.xml"), "line").count() == 2
    (tmp_path / "m.txt").write_text("; note\nkey: a: b\nterm: t（r）|cat|<i>d</i>\n")
    rows = readers.read_managed_text(spark, str(tmp_path / "m.txt"))
    assert {(r["key"], r["value"]) for r in rows.collect()} == {("key", "a: b"), ("term", "t（r）|cat|<i>d</i>")}
    assert [r["line"] for r in readers.glossary(rows).collect()] == ["【t】d"]
    cells = spark.createDataFrame([("s", 0, ["Cmd", "Text"]), ("s", 1, ["", "a"]), ("s", 2, ["//", "b"])], "sheet string, idx int, cells array<string>")
    assert [r["value"] for r in readers.sheet_column(cells, "Text").collect()] == ["a"]


def test_numbers_through_ranges(spark):
    rng = random.Random(2)
    names = [f"{rng.choice('ab')}{'0' * rng.randint(0, 2)}{rng.choice([rng.randint(0, 30), rng.randint(10**13, 10**16)])}{rng.choice(['', 'x'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").repartition(5)
    got = {r["i"]: r["number"] for r in resolve.numbered(df, [T.natural_key(F.col("n")), F.col("i")]).collect()}
    key = lambda i: ([(int(x), "") if x.isdigit() else (-1, x) for x in re.findall("[0-9]+|[^0-9]+", names[i])], len(names[i]), i)
    assert sorted(got.values()) == list(range(1, 301))
    assert sorted(got, key=got.get) == sorted(range(300), key=key)


def test_long_texts_have_the_same_grams(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc\n😀") for _ in range(k)) for k in (0, 3, 12, 511, 512, 513, 524, 600, 768, 2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.gram_list(F.col("t"), 12).alias("g")).collect()
    for r in rows:
        t = r["t"]
        assert r["g"] == ([t[i : i + 12] for i in range(len(t) - 11)] if len(t) >= 12 else [t] if t else [])


def test_eighteen_segments_and_deep_calls(spark):
    segs = [f"part {k}." for k in range(18)]
    rows = rows_of(spark, ["\n".join([*segs, "".join(segs), "", "x", "x", "xx", "ab", "", "b", "abb"])])
    got = sorted((r["line_no"], r["parts"]) for r in lines.concatenations(rows, "doc_id", "line_no", "line").collect())
    assert got == [(19, 18), (23, 2)]
    events = spark.createDataFrame([(str(k), p, f"{k}.{p}", str(k + 1) if p == 1 and k < 40 else None) for k in range(41) for p in (1, 12)], "node string, pos int, text string, callee string")
    order = [r["text"] for r in graph.expand_calls(events, "0").orderBy("path").collect()]
    assert order == [f"{k}.1" for k in range(41)] + [f"{k}.12" for k in range(40, -1, -1)]


def test_depth_first_order_of_crossing_paths(spark):
    rng = random.Random(6)
    for n in (8, 14):
        edges = [(s, p, rng.randrange(n)) for s in range(n) for p in rng.sample(range(0, 120, 9), 3) if s % 5]
        out, seen = [], set()

        def visit(x):
            if x not in seen:
                seen.add(x)
                out.append(x)
                for _, _, y in sorted(e for e in edges if e[0] == x):
                    visit(y)

        visit(1)
        got = graph.depth_first_order(spark.createDataFrame(edges, "src int, pos int, dst int"), spark.createDataFrame([(1,)], "node int"), spark.range(n).select(F.col("id").cast("int").alias("node")))
        assert [r["node"] for r in got.orderBy("path").collect()] == out + [x for x in range(n) if x not in seen]


def test_means_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], i % 7) for i in range(60)], "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, similarity.nearest_centroid(rows).collect()))
    monkeypatch.setattr(similarity, "MEANS_AT_ONCE", 8)
    assert sorted(map(tuple, similarity.nearest_centroid(rows).collect())) == whole


def test_folds_of_documents_make_no_group_each(spark):
    """Groups of pandas cost a call a document; rows of arrays go to Python in batches."""
    rows = rows_of(spark, ["a.\nb", "c"])
    for own in (resolve.greedy_sentences(rows), dedupe.by_document(rows, dedupe.drop_earlier_repeats)):
        plan = own._jdf.queryExecution().toString()
        assert "ArrowEvalPython" in plan and "FlatMapGroups" not in plan

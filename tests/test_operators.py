import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import assemble, graph, joins, ledger, lines, rules, similarity


def rows_of(spark, docs):
    return lines.lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))


def test_lines_and_neighbours(spark):
    rows = rows_of(spark, ["a\na\nb\n　 \na", None, ""])
    assert [tuple(r) for r in rows.orderBy("doc_id", "line_no").collect()] == [(0, 1, "a"), (0, 2, "a"), (0, 3, "b"), (0, 4, "　 "), (0, 5, "a"), (2, 1, "")]
    assert lines.filled(rows).count() == 4
    assert [r["line_no"] for r in lines.adjacent_duplicates(rows).collect()] == [2]
    assert {(r["line"], r["line_no"]) for r in lines.first_occurrences(rows.where("doc_id = 0"), ["line"], ["doc_id", "line_no"]).collect()} == {("a", 1), ("b", 3), ("　 ", 4)}
    assert [(r["line"], r["times"], r["first_line"]) for r in lines.repeated_in_document(rows).collect()] == [("a", 3, 1)]


def test_fences_and_look_ahead(spark):
    rows = rows_of(spark, ["x\n```\ny\n```\nz"])
    assert [r["line"] for r in lines.fence_state(rows).where("inside").collect()] == ["y"]
    ahead = lines.look_ahead(rows, F.when(F.col("line").rlike("[a-z]"), F.col("line")), "next", 2)
    assert [r["next"] for r in ahead.orderBy("line_no").collect()] == ["y", "y", "z", "z", None]


def test_prefix_variants_are_taken_pair_by_pair(spark):
    rows = rows_of(spark, ["0123456789\n0123456789a\n0123456789ab\nother\n0123456789\n0123456789x"])
    assert [r["line_no"] for r in lines.prefix_variants(rows).orderBy("line_no").collect()] == [1, 5]


def test_shared_blocks(spark):
    rows = rows_of(spark, ["a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny\nc\nd\ne", "q"])
    got = sorted(tuple(r) for r in lines.shared_blocks(rows, 3).collect())
    assert got == [(1, 0, 2, 5), (1, 0, 7, 9)]


def test_concatenations(spark):
    rows = rows_of(spark, ["a\nb\nab\nabab\nx"])
    assert [(r["line_no"], r["parts"]) for r in lines.concatenations(rows, "doc_id", "line_no", "line").orderBy("line_no").collect()] == [(3, 2), (4, 3)]


def test_ledger(spark):
    rows = rows_of(spark, ["aab\nb"])
    assert {(r["ch"], r["n"], r["first_line"]) for r in ledger.charset(rows).collect()} == {("a", 2, 1), ("b", 2, 1)}
    assert [r["ch"] for r in ledger.fresh(ledger.charset(rows), spark.createDataFrame([("a",)], "ch string")).collect()] == ["b"]
    assert [tuple(r) for r in ledger.conservation(rows_of(spark, ["a\na\nb"]), rows_of(spark, ["a\nb\nb"])).collect()] == [("a", 2, 1)]


def test_asof(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("z", 1)], "key string, at int")
    right = spark.createDataFrame([("k", 5, "a"), ("k", 7, None), ("k", 2, "b")], "key string, at int, v string")
    got = lambda strict: [(r["at"], r["v"]) for r in joins.asof(left, right, "key", "at", "v", strict).where("key = 'k'").orderBy("at").collect()]
    assert got(False) == [(1, None), (5, "a"), (9, None)] and got(True) == [(1, None), (5, "b"), (9, None)]


def test_ranges(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-50, 50)) for i in range(60)]
    ranges = [(i, a, a + rng.choice([0, 0.5, 3, 40])) for i, a in enumerate(rng.uniform(-50, 50) for _ in range(25))]
    df = joins.range_lookup(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, lo double, hi double"), "x", "lo", "hi", 5)
    assert sorted((r["p"], r["r"]) for r in df.collect()) == sorted((p, r) for p, x in points for r, a, b in ranges if a <= x < b)
    spans = [(i, rng.randint(0, 90), rng.randint(0, 12)) for i in range(30)]
    other = [(rng.randint(0, 90), rng.randint(0, 12)) for _ in range(8)]
    got = joins.overlapping(spark.createDataFrame(spans, "i int, s int, n int"), spark.createDataFrame(other, "s int, n int"), "s", "n", 7)
    assert sorted(r["i"] for r in got.collect()) == [i for i, s, n in spans if any(s < t + m and t < s + n for t, m in other if m) and n]


def test_grams_of_long_and_rare_texts(spark):
    texts = ["", "a", "ab", "a\nb\r\nc", "𠮟a𠮟𠮟b", "é" * 5, "\x00 \u2028x", None, "".join(chr(97 + i * i % 26) + ("𠮟" if i % 7 == 0 else "") for i in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    for n in (1, 3, 12):
        got = [r[0] for r in rows.select(T.gram_list(F.col("t"), n)).collect()]
        assert got == [None if t is None else [t[k : k + n] for k in range(len(t) - n + 1)] if len(t) >= n else [t] if t else [] for t in texts]


def test_containment_and_coverage(spark):
    got = joins.containment(spark.createDataFrame([(1, "abcdef"), (2, "zzzz")], "line_id int, line string"), spark.createDataFrame([(7, "xxabcdexx"), (8, "cdef"), (9, "abcdexx")], "item_id int, text string"), 3)
    assert [tuple(r) for r in got.collect()] == [(1, 7, 3, 0.75)]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(r) for r in joins.coverage(a, b, ["k"]).collect()} == {(1, "covered"), (3, "expected")}
    rows = spark.createDataFrame([("n", 1, "base"), ("n", 2, "patch")], "name string, prio int, v string")
    assert joins.latest(rows, ["name"], [F.col("prio")]).first()["v"] == "patch"


def test_containment_looks_for_marks_first(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdeé語😀") for _ in range(k))
    lines = [(k, word(rng.choice((2, 5, 9)))) for k in range(30)] + [(90, ""), (91, None)]
    texts = [(k, word(rng.randrange(60))) for k in range(200)] + [(500 + k, t) for k, t in lines] + [(800, "x" + lines[1][1] + "\n"), (801, None)]
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)} if len(t) >= 4 else {t} - {""}
    want = {}
    for k, line in lines:
        hits = max(((len(grams(line or "") & grams(t or "")), -i) for i, t in texts), default=(0, 0))
        if hits[0]:
            want[k] = (-hits[1], hits[0], hits[0] / len(grams(line)))
    a, b = spark.createDataFrame(lines, "line_id int, line string"), spark.createDataFrame(texts, "item_id int, text string").repartition(3)
    for name, value in (("CODES_AT_ONCE", 1 << 19), ("CODES_AT_ONCE", 11), ("BROADCAST_ROWS", 5)):
        monkeypatch.setattr(joins, name, value)
        assert {r["line_id"]: (r["item_id"], r["hits"], r["share"]) for r in joins.containment(a, b, 4).collect()} == want
    # Few grams that no line has leave the task that makes them.
    wanted = spark.createDataFrame([("abcd",), ("ab",)], "gram string")
    far = "".join(rng.choice("efgh") for _ in range(5000))
    got = spark.createDataFrame([(far + "abcd" + far,), ("ab",), ("",), (None,)], "text string").select(joins._may_hold(wanted, 2, 4)(F.col("text")).alias("g")).collect()
    assert "abcd" in got[0]["g"] and len(got[0]["g"]) < 200 and [r["g"] for r in got[1:]] == [["ab"], [], []]


def test_findings_of_rows_that_tell_their_declarations(spark):
    texts = ["a", "〓 \ufffd \"x", "ｦ\n･", "\ue000\n\uf8ff", "「a\nab_c\n:x:", "A/b.png\n|a/b\nAB_C", "<b>x\n@name", "#Name[1]\n&&\n＆＆", "\\n\n**AB\n${x}\n{x}", "語" * 201, "é" * 300 + "語" * 51, "é" * 300 + "語" * 50, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    declared = docs.select("doc_id", F.array(F.lit("a")).alias("allowed"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("é"))).alias("ledger"))
    found = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    own = rules.findings(docs.join(declared, "doc_id").localCheckpoint())
    assert found(own) == found(rules.findings(docs, declared=declared))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    by = {k: {r["rule_id"] for r in own.collect() if r["doc_id"] == k} for k in range(len(texts))}
    hits = {
        1: {"Q3_replacement_character", "Q4_geta_mark", "Q14_double_quote"}, 2: {"Q6_half_width_kana", "Q7_half_width_punctuation"}, 3: {"Q8_private_use"}, 4: {"Q10_unbalanced_quote", "Q11_resource_label", "Q11_inline_code"},
        5: {"Q11_resource_path", "Q11_numbered_resource", "Q11_upper_code"}, 6: {"Q12_inline_markup", "Q32_unresolved_macro"}, 7: {"Q32_unresolved_macro"}, 8: {"Q32_unresolved_macro"}, 9: {"Q30_wide_line"}, 10: {"Q30_wide_line"},
    }
    assert all(want <= by[k] for k, want in hits.items()) and "Q30_wide_line" not in by[11]


EVENTS = "doc_id long, pos long, kind string, text string"


def test_segments_and_dual_lines(spark):
    kinds = [("clear", ""), ("text", "a"), ("text", "b"), ("wait", ""), ("wait", ""), ("text", "c"), ("clear", ""), ("clear", ""), ("text", "d"), ("wait", ""), ("text", "")]
    events = spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(kinds)], EVENTS)
    segs = assemble.segments(events, assemble.Layout())
    assert [(r["page"], r["segment"], r["text"]) for r in segs.orderBy("page", "segment").collect()] == [(1, 1, "ab"), (1, 2, "c"), (2, 1, "d")]
    assert [(r["kind"], r["text"]) for r in assemble.dual_lines(segs).orderBy("line_no").collect()] == [("segment", "ab"), ("segment", "c"), ("page", "abc"), ("segment", "d")]
    assert assemble.page_maps(segs).first()["map"] == '{"pages":[{"segments":[1,2],"merged":3}]}'


@pytest.mark.parametrize(
    "pages, error",
    [
        ('[{"segments":[1,2],"merged":3}]', None),
        ('[{"segments":[1,2],"merged":3,"merged_text":"other"}]', "merged text differs"),
        ('[{"segments":[4,5],"merged":6,"merged_text":"q!"}]', None),
        ('[{"segments":[2,1],"merged":3}]', "segments not contiguous"),
        ('[{"segments":[1],"merged":2}]', "fewer than two segments"),
        ('[{"segments":[true,2],"merged":3}]', "not integers"),
        ('[{"segments":[5,6],"merged":7}]', "out of range"),
        ('[{"segments":[1,2],"merged":4}]', "merged line not after the last segment"),
        ('[{"segments":[1,2],"merged":3},{"segments":[1,2],"merged":3}]', "line used twice"),
        ("[]", "no pages"),
    ],
)
def test_page_maps(spark, pages, error):
    rows = rows_of(spark, ["a\nb\nab\nq\n?\nq!"])
    maps = spark.createDataFrame([(0, f'{{"pages":{pages}}}')], "doc_id long, map string")
    assert {r["error"] for r in assemble.validate_page_maps(maps, rows).collect()} == ({error} if error else set())


def test_speakers_last_until_cleared(spark):
    events = spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate([("text", "x"), ("name", "A"), ("text", "y"), ("name", ""), ("text", "z")])], EVENTS)
    assert [r["speaker"] for r in assemble.with_speakers(events).where("kind = 'text'").orderBy("pos").collect()] == [None, "A", None]


def test_graphs(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (2, 1, 3), (1, 1, 3), (3, 1, 0), (9, 1, 0)], "src int, pos int, dst int")
    roots = spark.createDataFrame([(0,)], "node int")
    reached = graph.reachable(edges, roots)
    assert {tuple(r) for r in reached.collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert [r["node"] for r in graph.depth_first_order(edges, roots).orderBy("path").collect()] == [0, 2, 3, 1]
    assert [r["node"] for r in graph.orphans(spark.createDataFrame([(0,), (9,)], "node int"), reached).collect()] == [9]


def test_ratio_is_that_of_plain_matching(monkeypatch):
    rng = random.Random(11)
    for held in (similarity.HELD, 0):
        monkeypatch.setattr(similarity, "HELD", held)
        for _ in range(400):
            signs = rng.choice(["ab", "abc ", "abcdefghij"])
            a = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
            b = "".join(rng.choice(signs) if rng.random() < 0.2 else c for c in a) if rng.random() < 0.5 else "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
            want = SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert similarity.matched_ratio(a, b) == want
            for least in (0.3, 0.6, 0.82):
                got = similarity.matched_ratio(a, b, least)
                assert got == want or max(got, want) < least


def test_long_lines_are_compared_in_time():
    rng = random.Random(12)
    a, b = ("".join(rng.choice("ab") for _ in range(8000)) for _ in range(2))
    begun = time.process_time()
    assert similarity.matched_ratio(a, a[:4000] + "!" + a[4001:], 0.6) == 2 * 7999 / 16000
    assert similarity.matched_ratio(a, b, 0.95) == 0 and time.process_time() - begun < 5


def test_similar_neighbours(spark):
    texts = ["hello there", "hello thera", "something else", ""]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, pos int, text string")
    got = similarity.similar_neighbours(rows, "k", "pos", "text").collect()
    assert [(r["pos"], r["ratio"]) for r in got] == [(0, SequenceMatcher(None, *texts[:2], autojunk=False).ratio())]
    bits = spark.createDataFrame([([1, 1, 0], [1, 0, 0])], "a array<int>, b array<int>")
    assert bits.select(similarity.overlap_of_bits(F.col("a"), F.col("b"))).first()[0] == 0.5


LONG = "\n".join(f"これは{k}行目です" for k in range(320))


@pytest.mark.parametrize(
    "text, found, absent",
    [
        ("あい。", set(), {"Q5_control_character", "Q12_inline_markup", "Q13_latin_letters"}),
        ("a\r\nb", {"Q2_carriage_return"}, set()),
        ("ｶ", {"Q6_half_width_kana"}, set()),
        ("｡", {"Q7_half_width_punctuation"}, {"Q6_half_width_kana"}),
        ("\ue000", {"Q8_private_use"}, set()),
        ("�", {"Q3_replacement_character"}, set()),
        ("〓", {"Q4_geta_mark"}, set()),
        ("\x07", {"Q5_control_character"}, set()),
        ("\x7f", {"Q5_control_character"}, set()),
        ("「あ", {"Q10_unbalanced_quote", "Q9_pair_「」"}, set()),
        ("『あ\n（い\n(う", {"Q9_pair_『』", "Q9_pair_（）", "Q9_pair_()"}, {"Q9_pair_「」"}),
        ("（￣ω￣", set(), {"Q9_pair_（）"}),
        ("、あ", {"Q15_leading_punctuation"}, set()),
        ("【春】\nx\n【春】", {"Q21_repeated_plate"}, {"Q20_symbol_plate"}),
        ("【春】\nx", set(), {"Q21_repeated_plate"}),
        ("【はる】\nx\n【はる】", set(), {"Q21_repeated_plate"}),
        ("【春…】\nx\n【春…】", set(), {"Q21_repeated_plate"}),
        ("【・・・】\nx\n【・・・】", {"Q20_symbol_plate"}, {"Q21_repeated_plate"}),
        ("【春】「あ」\n【春】「い」", {"Q22_plate_and_body"}, set()),
        ("【春】「あ」\n【夏】「い」", set(), {"Q22_plate_and_body"}),
        ("【春・店】「あ」\n【春・店】「い」", set(), {"Q22_plate_and_body"}),
        ("【春】言葉\n【春】言葉", set(), {"Q22_plate_and_body"}),
        ("春子：こんにちは", {"Q23_name_prefix"}, set()),
        ("送信者：春子", set(), {"Q23_name_prefix"}),
        ("第一幕：はじまり", set(), {"Q23_name_prefix"}),
        ("朝8：30", set(), {"Q23_name_prefix"}),
        ("party_chiriko", {"Q11_resource_label"}, set()),
        ("x:ld_n 8:", {"Q11_inline_code"}, set()),
        ("if a == 0 next", {"Q11_script_code"}, set()),
        ("maki/maki_t_001.PNG", {"Q11_resource_path"}, set()),
        ("wait 100,2", {"Q11_command_and_numbers"}, set()),
        ("|52/FUR_00270.", {"Q11_numbered_resource"}, set()),
        ("FUR_00270", {"Q11_upper_code"}, {"Q11_resource_label"}),
        *((x, {"Q32_unresolved_macro"}, set()) for x in ("@GameLast", "%s", "%.1d", r"あ\n", "＆＆", "&&", "**AA", "#Name[1]", "${First}", "%name%", "<firstname>", "{name}")),
        ("OK 100%", set(), {"Q32_unresolved_macro"}),
        ("x<br>", {"Q12_inline_markup"}, set()),
        ('あ"', {"Q14_double_quote"}, set()),
        ("あい\nあい", {"Q31_adjacent_duplicate"}, set()),
        ("あ\n\nい", {"Q29_blank_line"}, set()),
        ("あ\n", set(), {"Q29_blank_line"}),
        ("あ" * 201, {"Q30_wide_line"}, set()),
        ("x" * 201, set(), {"Q30_wide_line"}),
        (LONG, {"Q16_no_periods"}, set()),
        (LONG + "。あ", {"Q17_no_final_periods"}, set()),
        (LONG + "\nあ。", {"Q18_few_periods"}, {"Q19_many_commas"}),
        (LONG + "、" * 6 + "\nあ。", {"Q19_many_commas"}, set()),
        ("\n".join(f"line {i}" for i in range(320)), set(), {"Q16_no_periods"}),
        ("あ\nい\nあい", {"Q27_joined_rows_in_single"}, set()),
        ("é", {"Q33_foreign_characters"}, set()),
        ("♪", set(), {"Q33_foreign_characters"}),
    ],
)
def test_rules(spark, text, found, absent):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r["rule_id"] for r in rules.findings(docs).collect()}
    assert found <= got and not absent & got


def test_allowed_lines_and_profiles(spark):
    docs = spark.createDataFrame([(1, "ｶ"), (2, "ｶ\x07"), (3, "「")], "doc_id long, text string")
    allowed = spark.createDataFrame([(1, "ｶ"), (2, "ｶ\x07"), (3, "「")], "doc_id long, line string")
    profile = rules.Profile(severities={"Q5_control_character": "W", "Q33_foreign_characters": ""})
    got = {(r["doc_id"], r["rule_id"], r["severity"]) for r in rules.findings(docs, profile, allowed).collect()}
    assert got == {(2, "Q5_control_character", "W")}
    assert [(r["doc_id"], r["passed"]) for r in rules.verdicts(docs, rules.findings(docs)).orderBy("doc_id").collect()] == [(1, False), (2, False), (3, True)]


def test_what_is_declared_elsewhere(spark):
    docs = spark.createDataFrame([(1, "あ\nい\nあい", True), (2, "あé", False), (3, "あ", True), (4, None, True)], "doc_id long, text string, marked boolean")
    ledger = spark.createDataFrame([(1, "x"), (2, "x note")], "doc_id long, ch string")
    claims = spark.createDataFrame([(1, 3, None), (2, 2, "00"), (3, None, None)], "doc_id long, rows long, sha256 string")
    reports = spark.createDataFrame([(1, "Layout: dual"), (2, "layout: single"), (3, "Layout: dual\nLayout: single"), (4, "a dual layout")], "doc_id long, text string")
    of = lambda *p, **k: {(r["doc_id"], r["rule_id"]) for r in rules.findings(docs, *p, **k).collect()}
    got = of(rules.Profile(names=("い",), dual=True), ledger=ledger, claims=claims, reports=reports)
    assert {(2, "Q1_mark_missing"), (2, "Q24_name_absent_い"), (3, "Q24_name_absent_い"), (2, "Q34_unregistered_characters"), (3, "Q34_ledger_missing"), (2, "Q35_declared_rows"), (2, "Q36_digest_mismatch")} <= got
    assert {(2, "Q27_dual_without_joined_rows"), (2, "Q28_layout_mismatch"), (3, "Q28_layout_conflict"), (4, "Q28_layout_missing")} <= got
    assert not {r for i, r in got if i == 1} - {"Q13_latin_letters"}
    maps = spark.createDataFrame([(1, '{"pages":[{"segments":[1,2],"merged":3}]}'), (2, '{"pages":[{"segments":[1,2],"merged":3}]}'), (3, "{")], "doc_id long, map string")
    got = of(rules.Profile(expect_dual=True), maps=maps)
    assert {(1, "Q25_dual_expected"), (1, "Q26_pages_in_single"), (2, "Q26_page_map"), (3, "Q26_page_map_unreadable")} <= got and (1, "Q26_page_map") not in got
    assert (1, "Q16_no_periods_declared") in {(r["doc_id"], r["rule_id"]) for r in rules.findings(spark.createDataFrame([(1, LONG)], "doc_id long, text string"), rules.Profile(no_final_period=True)).collect()}


def test_rules_in_one_pass(spark):
    lines = ["a", "b", "ab", "abab", "", "ab", "x", "abx", "(", "(＾", "b"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (1, "(\n("), (2, ""), (None, "("), (5, "a\naa\naaa\naaaaaa\n")], "doc_id long, text string")

    def plain(own):
        n = 0
        for i, x in enumerate(own):
            rest, k, j = x, 0, i - 1
            while rest and j >= 0 and own[j] and rest.endswith(own[j]):
                rest, k, j = rest[: len(rest) - len(own[j])], k + 1, j - 1
            n += bool(x) and not rest and k >= 2
        return n

    rows = rules.annotated(docs, rules.Profile()).select(rules.joined_rows("own").alias("j"), "own")
    got = rows.collect()
    assert [len(r["j"]) for r in got] == [plain(r["own"]) for r in got] and sum(len(r["j"]) for r in got) == 5
    # Rows of one doc_id are judged one by one, a null id has no declarations, equal declarations count once.
    allowed = spark.createDataFrame([(1, "("), (1, "("), (None, "(")], "doc_id long, line string")
    claims = spark.createDataFrame([(2, 7, None), (2, 7, None), (2, 8, None)], "doc_id long, rows long, sha256 string")
    declared = {r["doc_id"]: r for r in rules.declarations(allowed, None, None, claims).collect()}
    assert declared[1]["allowed"] == ["("] and declared[1]["claims"] is None and len(declared[2]["claims"]) == 2 and set(declared) == {1, 2}
    found = [(r["doc_id"], r["rule_id"], r["count"]) for r in rules.findings(docs, allowed=allowed, claims=claims).collect()]
    assert [f for f in found if f[1].startswith("Q9")] == [(None, "Q9_pair_()", 1)]
    assert sorted(f for f in found if f[1] == "Q35_declared_rows") == [(2, "Q35_declared_rows", 0)] * 2
    assert sorted(f[2] for f in [(r["doc_id"], r["rule_id"], r["count"]) for r in rules.findings(docs).collect()] if f[1] == "Q9_pair_()") == [1, 1, 2]
    assert rules.findings(docs.limit(0), allowed=allowed).count() == 0


def test_text_functions(spark):
    one = spark.createDataFrame([("　 a<b>b</b>あ 　", "x10y2", ["A", "B"])], "t string, n string, v array<string>")
    c = F.col("t")
    row = one.select(
        T.strip_blanks(c), T.strip_markup(c), T.has_japanese(c), T.display_width(F.lit("aあ")), T.natural_key(F.col("n")), T.fill_slots(F.lit("%s-%s-%s"), F.col("v")), T.substitute(F.lit("@ab@a"), {"@a": "1", "@ab": "2"}),
        T.keep_ruby_base(F.lit("<ruby=r>base</ruby>")), T.merge_soft_breaks(F.lit("a\\n　b")), T.slug(F.lit("A b! C")), T.grams(F.lit("aaab"), 2), T.repeats_gram(F.lit("abab"), 2), T.share_of(F.lit("ab1"), "[0-9]"), T.bracket_depth(F.lit("((a)b)c)("), "(", ")"),
    ).first()
    assert list(row[:13]) == ["a<b>b</b>あ", "　 abあ 　", True, 1.5, ["x", "000210", "y", "00012", "", "0000000005"], "A-B-", "21", "base", "ab", "a-b-c", ["aa", "ab"], True, pytest.approx(1 / 3)]
    assert tuple(row[13]) == (1, 2, 1, 1)


def test_components_and_calls(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 2), (5, 4), (3, 3)] + [(k, k + 1) for k in range(20, 40)], "src int, dst int")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {9: 2, 8: 2, 7: 2, 2: 2, 5: 4, 4: 4, 3: 3, **dict.fromkeys(range(20, 41), 20)}
    events = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "call", "b"), ("a", 3, "y", None), ("b", 1, "in b", None), ("b", 2, "back", "a")], "node string, pos int, text string, callee string")
    assert [r["text"] for r in graph.expand_calls(events, "a").orderBy("path").collect()] == ["x", "call", "in b", "back", "y"]


def test_low_bounds_are_kept_by_neighbours(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcde ") for _ in range(60)) for _ in range(8)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, pos int, text string")
    want = {i: r for i, (a, b) in enumerate(zip(texts, texts[1:])) if (r := SequenceMatcher(None, a, b, autojunk=False).ratio()) >= 0.3}
    assert {r["pos"]: r["ratio"] for r in similarity.similar_neighbours(rows, "k", "pos", "text", 0.3).collect()} == want and want

"""Policies, flags of noise, contexts of characters, tags and adjacent quotes."""

import random

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import ledger, policies, repair


def test_policies_decide_with_reasons(spark):
    files = spark.createDataFrame([('{"include": ["a", "b", null], "exclude": ["c"]}',), ('{"exclude": ["b"]}',), ("no json",), (None,), ("{}",)], "text string")
    policy = policies.policy_table(files)
    assert {tuple(r) for r in policy.collect()} == {("a", True), ("b", False), ("c", False)}
    rows = spark.createDataFrame([(1, "a", None), (2, "b", True), (2, "b", True), (3, "x", True), (4, None, None)], "i int, name string, keep boolean")
    got = sorted((r["i"], r["kept"], r["reason"]) for r in policies.decided(rows, policy, "name", F.col("keep")).collect())
    assert got == [(1, True, "included"), (2, False, "excluded"), (2, False, "excluded"), (3, True, "default"), (4, False, "default")]
    assert policies.decided(rows, policy.limit(0), "name", F.lit(True)).where("kept and reason = 'default'").count() == 5


def test_noise_is_a_flag(spark):
    rows = spark.createDataFrame([(" ",), ("1, 2",), ("a.ogg",), ("OK",), ("Okay",), ("bg_01",)], "line string")
    kind = lambda *p: [r[0] for r in rows.select(policies.noise_kind(F.col("line"), *p)).collect()]
    assert kind(("OK",), (r"\.ogg$", "^bg_")) == ["blank", "numeric", "junk", "listed", "text", "junk"]
    assert kind((), ()) == ["blank", "numeric", "text", "text", "text", "text"]


def test_contexts_of_first_places(spark):
    rng = random.Random(3)
    rows = [(k % 40, "".join(rng.choice("abcdé𠮟Z") for _ in range(rng.randint(0, 9)))) for k in range(120)] + [(0, None), (3, "q" * 9 + "!" + "r" * 9)]
    df = spark.createDataFrame(rows, "line_no long, line string")
    got = {r["ch"]: (r["n"], r["first_line"], r["context"]) for r in ledger.with_context(ledger.charset(df), df, 3).collect()}
    want = {}
    for ch in {c for _, x in rows for c in x or ""}:
        n, first = sum((x or "").count(ch) for _, x in rows), min(k for k, x in rows if ch in (x or ""))
        line = min(x for k, x in rows if k == first and ch in (x or ""))
        want[ch] = (n, first, line[max(0, line.index(ch) - 3) : line.index(ch) + 4])
    assert got == want and got["!"][2] == "qqq!rrr"


def test_tags_indents_and_adjacent_quotes(spark):
    html = ["<a title='x > y'>t</a>", '<b c=">"><i>', "<p unclosed", "a < b > c", '<q z="', None, "<t " + "a='>' " * 5000 + ">"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(html)), "i int, h string").orderBy("i").select(T.tag_names(F.col("h"))).collect()]
    assert got == [["a", "/a"], ["b", "i"], [], [], [], None, ["t"]]
    assert spark.createDataFrame([("\u3000\t x \u3000",)], "c string").select(T.strip_indent(F.col("c"))).first()[0] == "x \u3000"
    quotes = ["「abcdef」「abcdeg」", "「abcd」「abxy」", "「abcdefN」「abcdefM」"]
    rows = spark.createDataFrame(list(enumerate(quotes)), "i int, c string").orderBy("i")
    of = lambda **k: [r[0] for r in rows.select(repair.adjacent_quotes(F.col("c"), **k)).collect()]
    assert of() == [["「abcdef」"], ["「abcd」", "「abxy」"], ["「abcdefN」"]]
    assert of(keep="last")[2] == ["「abcdefM」"] and of(name="N")[2] == ["「abcdefN」"] and of(name="Q")[2] == ["「abcdefM」"]

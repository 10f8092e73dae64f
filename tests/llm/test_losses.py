"""Rules that open tokens hide, hot labelled documents, rows without ids, and where tables stand."""

import random
import re
from collections import Counter
from pathlib import Path

from glyphmill.llm import line_dedup, toxicity, url_filter
from glyphmill.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_tokens():
    cases = {
        r"(?i)^[^?#]*/wp-login\.php": ["wp", "login"], r"/wp-login\.php$": ["wp", "login", "php"], r"x+$": [], r"^abc-": ["abc"], r"abc-": [], r"/a(?:b)?/c/": ["c"], r"/a(?:-|b)c/": [], r"/a(?:-|\.)c/": ["a", "c"], r"/a[-_]c[0-9]/": ["a"],
        r"/a[^b]c/": [], r"/a(?:/x)?c/": [], r"(?i)[?&;]ID=": ["id"], r"/é/a/": ["a"], r"-(?:ab)-": ["ab"], r"-(ab)-": [], r"(": [], r"/a|/b": [], r"/a\b/": [], r"/a*/b/": ["b"], r"-a(?:-)+b-": ["a", "b"],
    }
    assert {x: url_filter.whole_tokens(x) for x in cases} == cases


def test_tokens_that_go_on(spark):
    """The index finds what a plain scan finds, also where a token goes on in the URL."""
    rng = random.Random(9)
    pieces = ["wp-login.php", "wp-login", ".php", "x", "5", "/", "?", "#", "&", "cart", "/cart/checkout", "checkout", "doubleclick.net", "ad.", ":80", ".zip", ".exe", "zip", "phpsessid=", "?jsessionid=", "SESSIONID=", "=1", "-", "é", "http://a.net", "://", "/WP-LOGIN.PHP"]
    urls = [f"http://a.net{a}{x}{b}" for r in url_filter.PATTERN_RULES for x in (".zip", "/wp-login.php", "/cart/checkout", "?phpsessid=", ".doubleclick.net") for a in ("", "y", "/") for b in ("", "x", "5?x=1", "/", "_")]
    urls += ["http://" + "".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(10_000)]
    urls = list(dict.fromkeys(urls))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    got = {r["page_id"]: r["pattern"] for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.PATTERN_RULES)).collect()}
    for i, u in enumerate(urls):
        hits = sorted(r.label for r in url_filter.PATTERN_RULES if re.search(r.regex, u))
        assert got[i] == (hits[0] if hits else None), u


def test_a_hot_labelled_document(spark):
    rows = [(1, f"text {k}", "en", "a", 1) for k in range(300)] + [(i, "bad zorgle" if i % 2 else "good", "en", "a", 1) for i in range(2, 40)] + [(50, None, "en", "a", 1)] * 20
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 51)], "doc_id long, quality int, toxic int")
    rows = Counter((i, t) for i, t, *_ in rows)
    for most in (5, 60, 1000):
        scratch = Scratch(spark)
        used = toxicity.training_rows(df, labels, toxicity.CATEGORIES, most, scratch).collect()
        scratch.close()
        assert len(used) <= 3 * most + 10
    assert Counter((r["id"], r["text"]) for r in used) == rows  # all fit, as often as they stand there


def test_many_rows_without_an_id(spark):
    rng = random.Random(4)
    lines = [f"a line of some length {k}" for k in range(30)] + ["short", ""]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)))) for i in [*range(20), *[None] * 2000, 2**63 - 1]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keeper = {}
    for i, t in rows:
        for x in t.split("\n"):
            keeper[x] = min(keeper.get(x, 2**63), 2**63 - 1 if i is None else i)
    want = Counter()
    for i, t in rows:
        left = [x for x in t.split("\n") if len(x) < 10 or keeper[x] == (2**63 - 1 if i is None else i)]
        want[i, len(t.split("\n")), "\n".join(left)] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["kept"]) for r in line_dedup.dedup_lines(df).collect()) == want


def test_runs_stand_in_the_shared_folder(spark):
    runs = line_dedup.LineRuns(spark)
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    warehouse = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    before = {*warehouse.glob("*")}
    try:
        runs.add(spark.createDataFrame([(1, "a line of some length"), (2, "a line of some length")], "doc_id long, text string"))
        assert len(list(shared.glob("scratch-*/line_runs_*"))) == 1
        assert {*warehouse.glob("*")} == before
    finally:
        runs.close()
    assert not list(shared.glob("scratch-*/line_runs_*"))

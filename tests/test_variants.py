"""Aligned merging and repair to a fixpoint, against plain versions."""

import random
import tracemalloc

import pytest

from glyphmill.operators import variants


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if c == d else max(row[j + 1], row[j])
    return row[-1]


def test_alignment():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab 　雨\U0001f600") for _ in range(rng.randint(0, 14))) for _ in range(2))
        places = variants.common_places(a, b)
        assert len(places) == plain_common(a, b) and all(a[i] == b[j] for i, j in places)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(places, places[1:]))
        both, common, lost = variants.aligned(a, b)
        assert common == len(places)
        # Everything of b stays, in order; of a, what stands where b has nothing.
        rest = iter(both)
        assert all(c in rest for c in b)
        assert len(both) <= len(a) + len(b) and lost <= len(a)
    assert variants.aligned("今日は良い天気だ。", "今日は良い天気。")[0] == "今日は良い天気だ。"
    assert variants.aligned("abc", "abc") == ("abc", 3, 0) and variants.aligned("", "x") == ("x", 0, 0) and variants.aligned("xyz", "") == ("xyz", 0, 3)


def walked_back(a, b):
    """The way back through the whole table: up where that loses nothing, else left, else both."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (x == y))
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


@pytest.mark.parametrize("held", [1, 3, 4096])
def test_rows_in_blocks_keep_the_way(monkeypatch, held):
    monkeypatch.setattr(variants, "ROWS", held)
    rng = random.Random(21)
    for _ in range(300):
        # Different ends, so nothing is set aside before the table.
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert variants.common_places("x" + a + "x", "y" + b + "y") == [(i, j) for i, j in walked_back("x" + a + "x", "y" + b + "y")]


def test_long_rows_need_no_whole_table():
    rng = random.Random(22)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(9000)) for _ in range(2))
    tracemalloc.start()
    places = variants.common_places(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The whole table takes 324 MB.
    assert len(places) > 4000 and all(a[i] == b[j] for i, j in places) and peak < 40e6


def test_repair(spark):
    long = "そなたは誰に仕えるつもりなのか聞かせてもらおう。"
    cases = {
        f"「{long}「{long}」": f"「{long}」",
        f"「{long}」「{long}」": f"「{long}」",
        f"義経は{long}遮那は{long}": f"遮那王は{long}",
        f"（{long}）（{long}）": f"（{long}）",
        f"{long}{long}{long}": None,
        "「はい」「いいえ」": "「はい」「いいえ」",
        f"「{long}": f"「{long}",
        "短い": "短い",
        f"遮那王は{long}": f"遮那王は{long}",
        "": "",
    }
    rows = [(1, k, x) for k, x in enumerate(cases)] + [(1, 0, next(iter(cases))), (2, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, line string").repartition(3)
    got = variants.repaired(df, ["義経", "遮那"], "遮那王").collect()
    assert len(got) == len(rows)
    by = {r["line_no"]: r for r in got if r["doc_id"] == 1}
    for k, (line, want) in enumerate(cases.items()):
        assert want is None or by[k]["line"] == want, line
        assert (by[k]["how"] is None) == (by[k]["line"] == line)
    repair = variants.Repair(["義経", "遮那"], "遮那王", 10)
    for r in got:
        if r["how"]:
            assert repair.repeat(r["line"]) is None and r["line"].count("「") == r["line"].count("」")
    # What is repaired stays.
    again = variants.repaired(spark.createDataFrame([tuple(r)[:3] for r in got], df.schema), ["義経", "遮那"], "遮那王")
    assert again.where("how IS NOT NULL").count() == 0


def test_rounds_only_read_what_changed(spark, monkeypatch):
    df = spark.createDataFrame([(1, k, f"plain line number {k} of this text") for k in range(50)], "doc_id long, line_no long, line string")
    made, durable = [], variants.durable
    monkeypatch.setattr(variants, "durable", lambda x: made.append(durable(x)) or made[-1])
    assert variants.repaired(df, [], "").where("how IS NOT NULL").count() == 0
    assert [x.count() for x in made] == [50, 0, 0]

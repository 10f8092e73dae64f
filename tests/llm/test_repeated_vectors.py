"""Exact top-k where vectors and ids stand in many rows, against a plain version."""

from glyphmill.llm import vector_topk


def plain(rows, queries, k):
    out = []
    for q, a in sorted({(q, tuple(a)) for q, a in queries}):
        best = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(a, b)), i) for i, b in rows if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found(spark, rows, queries, k, parts=3):
    df = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<float>").repartition(parts)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_topk.top_k(df(rows), df(queries), k).collect())


def test_own_rows_take_no_places_of_equal_vectors(spark):
    hot, low = [2.0, 1.0], [0.5, 0.25]
    rows = [(50, hot)] * 7 + [(51, hot)] * 2 + [(52, hot)] + [(i, low) for i in range(60, 70)]
    queries = [(50, hot), (51, hot), (60, low)]
    assert found(spark, rows, queries, 5) == plain(rows, queries, 5)


def test_no_more_rows_than_wanted(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 5)]
    queries = [(9, [1.0, 0.0])]
    assert found(spark, rows, queries, 4, parts=1) == plain(rows, queries, 4)

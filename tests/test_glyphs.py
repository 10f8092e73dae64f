"""Pictures that are moved and inverted, against a plain comparison of dots."""

import random

from pyspark.sql import functions as F

from glyphmill.operators import similarity


def plain(a, b, w, h, reach):
    best = None
    for own in (a, [1 - x for x in a]):
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                moved = [b[(y + dy) * w + x + dx] if 0 <= y + dy < h and 0 <= x + dx < w else 0 for y in range(h) for x in range(w)]
                dots = sum(x | y for x, y in zip(own, moved))
                if dots:
                    best = max(best or 0.0, sum(x & y for x, y in zip(own, moved)) / dots)
    return best


def test_moved_and_inverted_glyphs(spark):
    rng = random.Random(11)
    for w, h, reach in ((5, 4, 1), (62, 2, 2), (3, 1, 2)):
        pairs = [([rng.randint(0, 1) for _ in range(w * h)], [rng.randint(0, 1) for _ in range(w * h)]) for _ in range(12)]
        pairs += [([0] * w * h, [0] * w * h), ([1] * w * h, [0] * w * h), ([1] * w * h, [1] * w * h)]
        rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<int>, b array<int>").orderBy("i")
        rows = rows.select("i", similarity.glyph_rows(F.col("a"), w).alias("a"), similarity.shifted_glyphs(similarity.glyph_rows(F.col("b"), w), w, reach).alias("b"))
        got = [r[0] for r in rows.select(similarity.glyph_overlap(F.col("a"), F.col("b"), w)).collect()]
        assert got == [plain(a, b, w, h, reach) for a, b in pairs]
    empty = spark.createDataFrame([([],), (None,), ([1, 1],)], "a array<int>").select(similarity.glyph_rows(F.col("a"), 3))
    assert [r[0] for r in empty.collect()] == [[], None, []]

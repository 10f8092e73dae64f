"""Quality scores: random Fourier features, ridge from summed normal equations, isotonic calibration.

Statistics of a whole text (shares of kinds of bytes, of words and of lines) are
standardised and mapped by random cosines, which approximate a Gaussian kernel.
Each task sums the normal equations of its rows by fold; the sums, whose size does
not depend on the data, are added up and solved with a ridge.  Scores of the
training rows come from the fold that left them out; their histogram is made
monotone (pool adjacent violators), which turns scores into probabilities.

Labels are learnt only from rows that are not held out: crc32 of the doc_id as text,
modulo 5, is not 0.  No more than `train_rows` of them are used, the smallest by
hash; the statistics and scores cover every document.

Defined results: null and empty texts have statistics of zero and are scored like
any other; rows with a null doc_id are scored and never trained on; with no labels of
both kinds every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed

TRAIN_ROWS = 100_000
FEATURES, FOLDS, PARTS, SEED = 256, 3, 8, 17
BINS = 2000
_KINDS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (9, 32), "line": (10,), "stop": b".", "comma": b",;:", "shout": b"!?",
    "symbol": b"#$%&*@^~+=_", "bar": b"|", "bracket": b"()[]{}<>", "quote": b"\"'`", "slash": b"/\\", "control": (*range(9), *range(11, 32), 127), "wide": range(128, 256),
}
_MASKS = np.array([[b in set(kind) for b in range(256)] for kind in _KINDS.values()], np.float64)
N_STATS = len(_KINDS) + 13


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; none says what it is about."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_STATS)
    words = raw.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    k = len(_KINDS)
    out[:k] = _MASKS @ counts / len(raw)
    lines = [x.strip() for x in raw.split(b"\n")]
    filled = [x for x in lines if x]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    widths = np.fromiter(map(len, filled), np.int64, len(filled))
    letters = max(1.0, counts[97:123].sum() + counts[65:91].sum())
    out[k:] = (
        np.log1p(len(words)), len(set(words)) / len(words), sizes.mean(), sizes.std(), np.log1p(sizes.max()), (sizes <= 3).mean(), (sizes >= 12).mean(), np.log1p(len(filled)),
        len(set(filled)) / len(filled), np.log1p(widths.mean()), (widths < 25).mean(), 1 - len(filled) / len(lines), counts[65:91].sum() / letters,
    )
    return out


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, x (the statistics)."""

    def run(frames):
        for rows in frames:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "x": [statistics(t).astype(np.float32) for t in rows["text"]]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, x array<float>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    levels: tuple[np.ndarray, np.ndarray]  # scores and their probabilities

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w, b = rng.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ w + b) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, *self.levels), 0, 1)


def _moments(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(frames):
        for rows in frames:
            x = np.array(rows["x"].tolist(), np.float64).reshape(-1, N_STATS)
            yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0)], "q": [(x**2).sum(axis=0)]})

    sums = sample.mapInPandas(run, "n long, s array<double>, q array<double>").toPandas()
    n = max(1, sums["n"].sum())
    mean, square = (np.array(sums[c].tolist()).reshape(-1, N_STATS).sum(axis=0) / n for c in "sq")
    return mean, np.sqrt(np.maximum(square - mean**2, 1e-8))


def fit(measured: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, ridge: float = 1e-3) -> Model:
    told = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    told = told.where(~held_out(F.col("doc_id")))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, train_rows / max(1, told.count()))
    sample = told.where(h < int(share * (1 << 30))).join(measured, "doc_id").withColumn("fold", (h % FOLDS).cast("int"))
    # The sample is bounded, so a fixed number of tasks will do.
    sample = checkpointed(sample.select("fold", "y", "x").repartition(PARTS))
    model = Model(*_moments(sample), np.zeros(FEATURES + 1), (np.array([0.0, 1.0]), np.array([0.5, 0.5])))

    def equations(frames):
        a, b, n = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1)), np.zeros(FOLDS)
        for rows in frames:
            z, y = model.features(np.array(rows["x"].tolist(), np.float64)), rows["y"].to_numpy()
            for f in range(FOLDS):
                own = rows["fold"].to_numpy() == f
                a[f] += z[own].T @ z[own]
                b[f] += z[own].T @ y[own]
                n[f] += own.sum()
        yield pd.DataFrame({"fold": range(FOLDS), "a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b], "n": n})

    sums = sample.mapInPandas(equations, "fold int, a binary, b binary, n double").toPandas()
    if not sums["n"].sum():
        return model
    a, b, n = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1)), np.zeros(FOLDS)
    for r in sums.itertuples():
        a[r.fold] += np.frombuffer(r.a).reshape(FEATURES + 1, FEATURES + 1)
        b[r.fold] += np.frombuffer(r.b)
        n[r.fold] += r.n
    solve = lambda a, b, n: np.linalg.solve(a + ridge * max(1.0, n) / FEATURES * np.eye(FEATURES + 1), b)
    apart = np.stack([solve(a.sum(axis=0) - a[f], b.sum(axis=0) - b[f], n.sum() - n[f]) for f in range(FOLDS)])
    model.weights = solve(a.sum(axis=0), b.sum(axis=0), n.sum())

    def histogram(frames):
        for rows in frames:
            z = model.features(np.array(rows["x"].tolist(), np.float64))
            s = np.einsum("ij,ij->i", z, apart[rows["fold"].to_numpy()])
            bins = np.clip((s + 1) / 3 * BINS, 0, BINS - 1).astype(int)
            yield pd.DataFrame({"bin": bins, "n": 1.0, "y": rows["y"], "s": s}).groupby("bin", as_index=False).sum()

    bins = sample.mapInPandas(histogram, "bin int, n double, y double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("s").alias("s"))
    model.levels = isotonic(*bins.orderBy("bin").toPandas()[["n", "y", "s"]].to_numpy().T)
    return model


def isotonic(n: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean scores and rising probabilities of pooled bins (counts, sums of labels, sums of scores, in order)."""
    pools: list[list[float]] = []
    for pool in zip(n, y, s):
        pools.append(list(pool))
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    # A pool of few rows says little: one row of either label is added.
    return np.array([p[2] / p[0] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[0] + 1) for p in pools])


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of `documents`."""
    measured = checkpointed(measure(documents))
    model = fit(measured, labels, train_rows)

    def run(frames):
        for rows in frames:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": model.score(np.array(rows["x"].tolist(), np.float64).reshape(-1, N_STATS))})

    scored = measured.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Toxicity by a classifier chain.

The categories stand in a fixed order, each with a linear (logistic) model over the
counts of chosen words and word beginnings (the first 4, 5 or 6 bytes, so that a stem
with many endings counts as one) and a few numbers about the text's form; the models after
the first also see the logits of the earlier categories.  While training, those logits
come from models that did not see the row (out of fold); when scoring, from the final models.
The words are chosen by how much their presence differs between the two labels, counted
in the training rows by Spark.

`labels` marks toxicity and quality only, so the earlier categories are parts of it that
these and the language tell apart: abuse in junk, and abuse in other languages than
English.  They overlap and don't add up to the last category, any abuse, which decides.
Training uses at most `train_rows` labelled rows, the smallest by hash of doc_id; only their
counts of at most `n_words` forms reach the driver.  Every document's whole text is scored.

Texts are worked on in slices of bounded bytes, so a task's memory depends on neither
the number nor the length of the documents (but for one text that is longer than a slice).

Defined results: null and empty texts have no words and get the probability of that;
repeated rows each get a row; rows with a null doc_id are scored and never trained on; of
labels that contradict each other the larger counts; a category without labels of both
kinds has its share of label 1 as probability, and one without any label has nearly 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Scratch, slices
from glyphmill.llm.decontaminate import words_of

TRAIN_ROWS, N_WORDS, FOLDS = 20_000, 300, 3
#: A document is rejected from this probability of the last category on.
THRESHOLD = 0.3
#: Names and label expressions over toxic, quality and lang, in the order of the chain; the last one decides.
CATEGORIES = (("junk_abuse", "toxic = 1 and quality = 0"), ("foreign_abuse", "toxic = 1 and lang <> 'en'"), ("toxic", "toxic = 1"))
#: Words whose forms a task remembers at once.
REMEMBERED = 100_000
#: Numbers about the form of a text.
N_FORM = 4
_SYMBOLS = np.isin(np.arange(256), list(b"#$%&*@^~+=_|")).astype(np.float32)


def tokens(text: str | None) -> list[bytes]:
    """Words of a whole text in lower case, letters beyond ASCII too."""
    return words_of(text.lower()) if text else []


def forms(word: bytes) -> tuple[bytes, ...]:
    """The word, and its beginnings with a star."""
    return (word, *(word[:k] + b"*" for k in (4, 5, 6) if len(word) >= k))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, rounds: int = 25, block: int = 2048) -> np.ndarray:
    """Newton's method over blocks of rows; the last column of x is the constant and isn't shrunk."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    base = np.clip(y.mean(), 1e-4, 1 - 1e-4) if len(y) else 1e-4
    w[-1] = np.log(base / (1 - base))
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(rounds):
        curve, slope = np.diag(keep), keep * w
        for at in range(0, len(x), block):
            some = x[at : at + block].astype(np.float64)
            p = _sigmoid(some @ w)
            curve = curve + (some * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ some
            slope = slope + some.T @ (p - y[at : at + block])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class _Known(dict):
    """Word to the numbers of its chosen forms; filled as words come."""

    def __init__(self, words: dict[bytes, int]):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        get = self.words.get
        self[word] = out = tuple(k for f in forms(word) if (k := get(f)) is not None)
        return out


def _form(text: str | None, n_words: int) -> tuple[float, ...]:
    """Logarithm of the words, and shares of capitals, of symbols, and of bytes beyond ASCII."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return (0.0,) * N_FORM
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.log1p(n_words), counts[65:91].sum() / len(raw), float(_SYMBOLS @ counts) / len(raw), counts[128:].sum() / len(raw)


@dataclass
class Chain:
    words: dict[bytes, int]
    names: list[str]
    models: list[np.ndarray] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.words) + N_FORM

    def counts(self, texts: list[str | None], known: _Known | None = None) -> np.ndarray:
        """A row per text: logarithms of the counts of the chosen forms, and the form of the text."""
        known = _Known(self.words) if known is None else known
        out = np.zeros((len(texts), self.width), np.float32)
        for row, text in zip(out, texts):
            found = tokens(text)
            for hit in filter(None, map(known.__getitem__, found)):
                for k in hit:
                    row[k] += 1
            np.log1p(row, out=row)
            row[len(self.words) :] = _form(text, len(found))
            if len(known) > REMEMBERED:
                known.clear()
        return out

    @staticmethod
    def design(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
        return np.hstack([x, *[_logit(p)[:, None] for p in earlier], np.ones((len(x), 1))]).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        """y: a column per category."""
        earlier: list[np.ndarray] = []
        for c in range(y.shape[1]):
            d = self.design(x, earlier)
            self.models.append(fit_logistic(d, y[:, c]))
            apart = np.zeros(len(x))
            for f in range(FOLDS):
                own = fold == f
                apart[own] = _sigmoid(d[own] @ fit_logistic(d[~own], y[~own, c]))
            earlier.append(apart)

    def predict(self, x: np.ndarray) -> list[np.ndarray]:
        """The probability of each category, in order."""
        out: list[np.ndarray] = []
        for w in self.models:
            out.append(_sigmoid(self.design(x, out) @ w))
        return out


def training_rows(documents: DataFrame, labels: DataFrame, categories, train_rows: int, scratch: Scratch) -> DataFrame:
    """id, text, y, fold of the labelled rows that are used. Their ids and labels, at most `train_rows` rows, are broadcast.

    Rows that are repeated count as often.  Where the ids stand in more rows than `train_rows`, a share of the different
    rows is chosen by hash, and repeats count by that share, but once at least: about twice `train_rows` rows at most, however hot an id is.
    """
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    told = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    told = told.select("id", "toxic", "quality", h.alias("h"), (h % FOLDS).cast("int").alias("fold"))
    share = min(1.0, train_rows / max(1, told.count()))
    # The limit only guards the bound of the broadcast; the hash has chosen the rows.
    told = told.where(F.col("h") < int(share * (1 << 30))).orderBy("h", "id").limit(train_rows)
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text", "lang").join(F.broadcast(told), "id")
    y = F.array(*[F.coalesce(F.expr(e).cast("double"), F.lit(0.0)) for _, e in categories])
    rows = scratch.table(rows.select("id", "text", y.alias("y"), "fold").groupBy("id", "text", "y", "fold").agg(F.count("*").alias("k")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0))).first()
    if total > train_rows:
        own = F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, train_rows / n) * (1 << 30))
        rows = rows.where(own).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("k") * F.lit(train_rows / total))))
    return rows.select("id", "text", "y", "fold", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k").cast("long")))).drop("col")


def choose_words(rows: DataFrame, n_words: int, least: float = 20.0) -> list[bytes]:
    """The forms whose presence speaks most for the last category, by chi-squared: at most `n_words` of the 8 * n_words that speak most."""

    def run(batches):
        every, toxic, docs = Counter(), Counter(), np.zeros(2)
        for batch in batches:
            for some in slices(batch):
                for text, y in zip(some.column("text").to_pylist(), some.column("y").to_pylist()):
                    own = {f for w in set(tokens(text)) for f in forms(w)}
                    every.update(own)
                    docs += 1, y[-1]
                    if y[-1]:
                        toxic.update(own)
        every[b""], toxic[b""] = docs  # the empty word counts documents
        words = list(every)
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), pa.array([float(every[w]) for w in some]), pa.array([float(toxic[w]) for w in some])], names=["word", "n", "pos"]
            )

    sums = rows.select("text", "y").mapInArrow(run, "word binary, n double, pos double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    total = sums.where(F.octet_length("word") == 0).first()
    if not total or not total["pos"] or total["pos"] == total["n"]:
        return []
    n, pos = F.col("n"), F.col("pos")
    expected = n * (total["pos"] / total["n"])
    chi = (pos - expected) * (pos - expected) / (expected * (1 - n / (total["n"] + 1)))
    best = sums.where((F.octet_length("word") > 0) & (n >= 3) & (pos > expected) & (chi >= least)).orderBy(chi.desc(), F.length("word").desc(), "word").limit(8 * n_words)
    chosen: dict[bytes, float] = {}
    for form, found in ((bytes(r["word"]), r["n"]) for r in best.select("word", "n").collect()):
        stem = form.rstrip(b"*")
        # A form adds nothing where a beginning of it has been chosen already, or, as a beginning, where it stands in hardly more documents than one that goes on.
        known = any(stem[:k] + b"*" in chosen for k in (4, 5, 6) if k <= len(stem))
        if not known and not (form != stem and any(g.startswith(stem) and found <= 1.05 * n for g, n in chosen.items())):
            chosen[form] = found
    return list(chosen)[:n_words]


def train(documents: DataFrame, labels: DataFrame, categories=CATEGORIES, train_rows: int = TRAIN_ROWS, n_words: int = N_WORDS) -> Chain:
    scratch = Scratch(documents.sparkSession)
    # The documents are read once for the bounded sample, which is then read twice.
    rows = training_rows(documents, labels, categories, train_rows, scratch)
    chain = Chain({w: k for k, w in enumerate(choose_words(rows, n_words))}, [c for c, _ in categories])

    def run(batches):
        known = _Known(chain.words)
        for batch in batches:
            for some in slices(batch):
                x = chain.counts(some.column("text").to_pylist(), known)
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), some.column("y"), some.column("fold")], names=["id", "x", "y", "fold"])

    got = rows.mapInArrow(run, "id long, x binary, y array<double>, fold int").toArrow()
    scratch.close()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, chain.width)
    y = np.array(got.column("y").to_pylist(), np.float64).reshape(-1, len(categories))
    order = np.lexsort((*x.T[:3], got.column("id").to_numpy()))
    chain.fit(x[order], y[order], got.column("fold").to_numpy()[order])
    return chain


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """row (struct of the document's columns) and the probability of each category."""
    df = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    schema = T.StructType([df.schema["row"], *[T.StructField(c, T.DoubleType()) for c in chain.names]])

    def run(batches):
        known = _Known(chain.words)
        for batch in batches:
            for some in slices(batch, batch.column("row").field("text")):
                x = chain.counts(some.column("row").field("text").to_pylist(), known)
                yield pa.RecordBatch.from_arrays([some.column("row"), *map(pa.array, chain.predict(x))], names=["row", *chain.names])

    return df.mapInArrow(run, schema)


def clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `documents` whose last category is less likely than `threshold`, unchanged."""
    chain = train(documents, labels)
    return score(documents, chain).where(F.col(chain.names[-1]) < threshold).select("row.*")

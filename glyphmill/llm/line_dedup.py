"""Line deduplication against levelled, sorted runs of line hashes (DataFrame functions only).

A line's key is the line with white space stripped at both ends and A-Z lower-cased;
keys of fewer than `least` code points never count.  A run is a table of (hash of a
key, smallest doc_id that has it), sorted by hash.  Documents come in batches of
rising doc_id: the keys of a batch are merge-joined with every run, those that no
run has (the anti join) become a new run of level 0, and when a level has `fanout`
runs they are merged into one of the next level.  A line is dropped if its key's
smallest doc_id is another one.

Runs and the keys of a batch are bucketed alike by hash, one sorted file a bucket, so
neither the joins nor the merges shuffle a run; only a batch's own keys are dealt out.

The key's 128 bits of hash stand for it.  Keys meet only as hashes and ids, summed in the
map tasks first; a line that a third of all documents share is one key of the
aggregation, and the join that tells its documents is one that Spark may split.
Every batch's decisions are checkpointed, so its runs may be merged and dropped.

Defined results: a null or empty text is one empty line; a null doc_id counts as the
largest; rows that share a doc_id are one document for the count of documents, and
each gets its own row; repeated lines of the document that keeps a key all stay.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import BLANKS, Scratch, ascii_lower, checkpointed

#: A null doc_id.
LAST = 2**63 - 1


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


class LineRuns:
    """The runs of one store; each is a table whose files stand in the shared folder, until close()."""

    def __init__(self, spark: SparkSession, least: int = 10, fanout: int = 2):
        self.spark, self.least, self.fanout, self.scratch = spark, least, fanout, Scratch(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made: set[str] = set()
        self.count = 0
        self.name = f"line_runs_{uuid.uuid4().hex}"

    def _store(self, rows: DataFrame, dealt: bool = False) -> str:
        """rows as a bucketed, sorted table; `dealt`: whether they come in its buckets already."""
        name = f"{self.name}_{self.count}"
        self.count += 1
        self.made.add(name)
        rows = rows if dealt else rows.repartition(self.buckets, "h1", "h2")
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name, path=self._path(name))
        return name

    def _path(self, name: str) -> str:
        return f"{self.scratch.folder}/{name}"

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.delete(self._path(name))  # the files aren't the catalogue's
        self.made.discard(name)

    def _add(self, table: str, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            # No two runs share a key, so a full merge join of their buckets is their union.
            merged = self.spark.table(old[0])
            for t in old[1:]:
                other = self.spark.table(t).withColumnRenamed("first", "other")
                merged = merged.join(other.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("first", "other").alias("first"))
            self._add(self._store(merged, True), level + 1)
            for t in old:
                self._drop(t)

    def keys(self, batch: DataFrame) -> DataFrame:
        """d (doc_id), h1, h2: the long keys of each row, once."""
        lines = F.split(ascii_lower(F.col("text")), "\n", -1)
        own = F.array_distinct(F.filter(F.transform(lines, _key), lambda k: F.length(k) >= self.least))
        rows = batch.where("text is not null").select(_id().alias("d"), F.explode(own).alias("k"))
        return rows.select("d", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))

    def add(self, batch: DataFrame) -> DataFrame:
        """d, h1: the keys that each document of the batch loses. Batches come in rising order of doc_id."""
        keys = self.keys(batch)
        name = self._store(keys.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last")))
        told = self.spark.table(name).withColumn("known", F.lit(None).cast("long"))
        for k, t in enumerate(t for level in self.levels for t in level):
            run = self.spark.table(t).withColumnRenamed("first", f"known{k}")
            told = told.join(run.hint("merge"), ["h1", "h2"], "left").withColumn("known", F.coalesce("known", f"known{k}")).drop(f"known{k}")
        run = self._store(told.where("known is null").select("h1", "h2", "first"), True)
        rule = told.where("known is not null or last > first").select("h1", "h2", F.least("known", "first").alias("keeper"))
        # Out of its buckets, so that Spark may split the rows of a line that very many documents share.
        rule = self.scratch.table(rule)
        lost = checkpointed(keys.join(rule, ["h1", "h2"]).where("d > keeper").select("d", "h1"))
        self.scratch.drop(rule)
        self._drop(name)
        self._add(run)
        return lost

    def close(self) -> None:
        for t in list(self.made):
            self._drop(t)
        self.levels = []


def batches(documents: DataFrame, n: int) -> list[DataFrame]:
    """The documents cut at quantiles of doc_id; rows of one doc_id stay together."""
    cuts = documents.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 1000)).first()[0] if n > 1 else None
    cuts, own, out = sorted({*(cuts or [])}), F.col("doc_id"), []
    for k in range(len(cuts) + 1):
        # Plain comparisons reach the scan. Null, which counts as the largest, is in the last batch.
        above = (own > cuts[k - 1]) if k else F.lit(True)
        out.append(documents.where(above & (own <= cuts[k]) if k < len(cuts) else above | own.isNull()))
    return out


def dedup_lines(documents: DataFrame, least: int = 10, n_batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: a row per row of `documents`."""
    documents = documents.select("doc_id", "text")
    runs = LineRuns(documents.sparkSession, least, fanout)
    try:
        lost = reduce(DataFrame.unionByName, [runs.add(b) for b in batches(documents, n_batches)])
    finally:
        runs.close()
    gone = lost.where(F.col("d") < LAST).groupBy("d").agg(F.collect_set("h1").alias("gone"))
    docs = documents.where(_id() < LAST).select("doc_id", "text", _id().alias("d")).join(gone, "d", "left").drop("d")
    unnamed = documents.where(_id() == LAST)
    if not unnamed.isEmpty():
        # Rows without doc_id are one document, but each is told its own lost keys only.
        unnamed = runs.scratch.table(unnamed.withColumn("d", F.monotonically_increasing_id()))
        keys = runs.keys(unnamed.select(F.col("d").alias("doc_id"), "text")).select("d", "h1")
        own = keys.join(lost.where(F.col("d") == LAST).select("h1").distinct(), "h1").groupBy("d").agg(F.collect_set("h1").alias("gone"))
        docs = docs.unionByName(unnamed.join(own, "d", "left").drop("d"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def stays(line: Column) -> Column:
        key = _key(ascii_lower(line))
        return (F.length(key) < least) | ~F.array_contains("gone", F.xxhash64(key))

    docs = docs.select("doc_id", lines.alias("lines"), "gone")
    docs = docs.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    return docs.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept")
    )

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import durable, shared_folder

__all__ = ["BLANKS", "LOWER", "UPPER", "WORD", "Scratch", "ascii_lower", "checkpointed", "durable", "mix64", "packed", "shared_folder", "slices", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The six white-space characters U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; Spark deletes it when nothing refers to it (where its cleaner is told to)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that one operator writes on its way, in a folder of the shared one; drop() deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made, self.stand = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0, set()

    def table(self, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read again: no lineage, and its true size."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        out._scratch = path
        self.stand.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        self.delete(*(t._scratch for t in tables))

    def delete(self, *paths: str) -> None:
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.stand.discard(p)

    def close(self) -> None:
        """All tables made here go."""
        self.delete(*self.stand)

    def last(self, df: DataFrame) -> DataFrame:
        """df, written as a table; all other tables made here go, so the result is all that stays."""
        before = list(self.stand)
        out = self.table(df)
        self.delete(*before)
        return out


def slices(batch: pa.RecordBatch, texts: pa.Array | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts (its column `text`, or those given) have at most `most` bytes; a longer text is a piece of its own. No bytes are copied."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text") if texts is None else texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def packed(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit numbers as one Arrow list array of longs."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.int64)]).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the SplitMix64 finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

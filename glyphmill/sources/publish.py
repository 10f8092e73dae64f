"""Members that are replaced together or not at all.

A work's members (name, data) stand in numbered editions under one folder; a file `current.txt` names the one
that readers take.  A new edition is written aside by Spark's own writer, read back, compared with what was there, and
only then named: the last step is one rename, so a reader sees the old members or the new ones.  Everything goes
through the file system of the path, which may be any that Spark reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rejected(ValueError):
    """The new members weren't taken; the old ones stand."""


@dataclass(frozen=True)
class Edition:
    """What a publication did, or would do: the edition's number, and how many members are new, changed, the same, gone."""

    number: int
    added: int
    changed: int
    same: int
    removed: int


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}")


def current(spark: SparkSession, path: str) -> int:
    """The edition that readers take; 0 where nothing was published yet."""
    fs, at = _fs(spark, path)
    if not fs.exists(at("current.txt")):
        return 0
    return int(spark.read.text(f"{path}/current.txt").first()[0])


def read_members(spark: SparkSession, path: str, edition: int | None = None) -> DataFrame:
    """name, data of the current edition, or of one of those before."""
    number = current(spark, path) if edition is None else edition
    if not number:
        return spark.createDataFrame([], "name string, data binary")
    return spark.read.parquet(f"{path}/edition-{number}")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change: `added`, `changed`, `same` or `removed`. Bytes are compared by digest, so none is shuffled."""
    digest = F.sha2("data", 256)
    a, b = old.select("name", digest.alias("a"), F.lit(True).alias("was")), new.select("name", digest.alias("b"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, "name", "full").select("name", change.alias("change"))


def publish(members: DataFrame, path: str, verify: Callable[[DataFrame, DataFrame], DataFrame] | None = None, dry_run: bool = False) -> Edition:
    """Makes members(name, data) the current edition, if its names are there and differ, and verify(old, new) gives no row.

    The new members are written aside first and judged as read back, so what was verified is what readers get. With complaints, or when
    anything fails before the last rename, the staged files go, and Rejected (or the failure) is raised; the old edition is untouched
    and stays readable by its number. Members that are all the same as before make no edition, and a dry run makes none either.
    """
    spark = members.sparkSession
    fs, at = _fs(spark, path)
    number, staged = current(spark, path), f"_staged-{uuid.uuid4().hex}"
    try:
        members.select("name", "data").write.parquet(f"{path}/{staged}")
        old, new = read_members(spark, path), spark.read.parquet(f"{path}/{staged}")
        wrong = new.groupBy("name").agg(F.count("*").alias("k")).where("name IS NULL OR k > 1")
        complaints = [f"{r['name']}: {r['k']} members of this name" for r in wrong.limit(5).collect()]
        if not complaints and verify is not None:
            complaints = [str(r.asDict()) for r in verify(old, new).limit(5).collect()]
        if complaints:
            raise Rejected("; ".join(complaints))
        n = {r["change"]: r["count"] for r in changes(old, new).groupBy("change").count().collect()}
        counts = [n.get(k, 0) for k in ("added", "changed", "same", "removed")]
        unchanged = number > 0 and not (counts[0] or counts[1] or counts[3])
        if dry_run or unchanged:
            return Edition(number, *counts)
        # Numbers are never used twice, also after a way back and after an edition that was moved but never named.
        used = [int(f.getPath().getName().removeprefix("edition-")) for f in fs.globStatus(at("edition-*"))]
        fresh = max(used, default=0) + 1
        if not fs.rename(at(staged), at(f"edition-{fresh}")):
            raise OSError(f"can't move {staged}")
        _name(spark, path, fresh)
        return Edition(fresh, *counts)
    finally:
        fs.delete(at(staged), True)


def _name(spark: SparkSession, path: str, number: int) -> None:
    """Lets `current.txt` name an edition. The rename replaces the file in one step."""
    fs, at = _fs(spark, path)
    out = fs.create(at("next.txt"), True)
    out.write(bytearray(f"{number}\n".encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(at("next.txt"), at("current.txt"), options)


def back_to(spark: SparkSession, path: str, edition: int) -> None:
    """Makes an earlier edition the current one again."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"edition-{edition}")):
        raise ValueError(f"no edition {edition}")
    _name(spark, path, edition)

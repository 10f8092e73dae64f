"""What a work leaves out: policies as tables, and flags of noise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.session import durable, hinted

POLICY = "struct<include:array<string>,exclude:array<string>>"


def policy_table(files: DataFrame, text: str = "text") -> DataFrame:
    """name, keep: the names of JSON policies {"include": [...], "exclude": [...]}, one document per row.

    A name that any policy excludes is excluded; names that are null are left out, and so is a text that is no such document.
    """
    own = files.select(F.from_json(text, POLICY).alias("p"))
    part = lambda field, keep: own.select(F.explode(f"p.{field}").alias("name"), F.lit(keep).alias("keep"))
    return part("include", True).unionByName(part("exclude", False)).where("name is not null").groupBy("name").agg(F.min("keep").alias("keep"))


def decided(rows: DataFrame, policy: DataFrame, name: str, otherwise: Column) -> DataFrame:
    """rows with kept, and reason ('included', 'excluded' or 'default'): what policy(name, keep) says of a row's name, else `otherwise` (null: not kept).

    The policy is written and counted; it is broadcast up to a bound and joined by shuffle beyond.
    """
    own = hinted(durable(policy.groupBy(F.col("name").alias("_name")).agg(F.min("keep").alias("_keep"))))
    out = rows.join(own, rows[name] == own["_name"], "left")
    reason = F.when(F.col("_keep"), "included").when(~F.col("_keep"), "excluded").otherwise("default")
    return out.withColumn("kept", F.coalesce("_keep", otherwise, F.lit(False))).withColumn("reason", reason).drop("_name", "_keep")


def noise_kind(c: Column, listed: Iterable[str], resources: Iterable[str], numeric: str = r"^[0-9 .,]+$") -> Column:
    """A flag, so nothing is lost: 'blank', 'numeric', 'junk' (one of the resources' patterns), 'listed' (the whole line), or 'text'."""
    junk = "|".join(f"(?:{r})" for r in resources)
    return T.first_fitting(c, ((F.trim(c) == "", "blank"), (c.rlike(numeric), "numeric"), (c.rlike(junk) if junk else F.lit(False), "junk"), (c.isin(*listed), "listed")), "text")

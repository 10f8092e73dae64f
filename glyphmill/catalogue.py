"""All queries on the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.plans import assembly, extras, relational, sampler, scripts, structure, texts, validation
from glyphmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "assembly", "extras", "flagship", "relational", "sampler", "scripts", "structure", "texts", "validation"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["findings_all"](spark, sf_dir)

"""Where the query modules register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the same in DuckDB's SQL where that can be said."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The lines of `documents` in SQL.
LINES = "l AS (SELECT doc_id, unnest(s) AS line, CAST(generate_subscripts(s, 1) AS BIGINT) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"

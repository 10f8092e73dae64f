"""Readers of script tables and documents by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str = ",", schema: str | None = None) -> DataFrame:
    """Delimited text with a header; without a schema every column is a string, so nothing is read twice."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("sep", separator).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_managed_text(spark: SparkSession, path: str) -> DataFrame:
    """path, key, value of `key: value` lines; lines that begin with ; are comments."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(~F.col("value").rlike(r"^\s*(;|$)") & F.col("value").contains(":"))
    return rows.select("path", F.trim(F.regexp_extract("value", "^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract("value", "^[^:]*:(.*)$", 1)).alias("value"))


def glossary(rows: DataFrame) -> DataFrame:
    """line of rows(value) of the form `term | category | description`, as the glossary prints it."""
    parts = F.transform(F.split("value", r"\|"), lambda p: F.trim(F.regexp_replace(p, r"<[^>]*>", "")))
    return rows.select(parts.alias("p")).where(F.size("p") == 3).select(F.concat(F.lit("【"), F.regexp_replace(F.col("p")[0], r"[（(][^）)]*[）)]", ""), F.lit("】"), F.col("p")[2]).alias("line"))


def sheet_column(rows: DataFrame, name: str) -> DataFrame:
    """sheet, idx, value of a named column of rows(sheet, idx, cells), whose row 0 is the header; comment rows (//) are left out."""
    head = rows.where("idx = 0").select("sheet", F.array_position("cells", F.lit(name)).cast("int").alias("at")).where(F.col("at") > 0)
    body = rows.where("idx > 0").where(~F.coalesce(F.get("cells", F.lit(0)).startswith("//"), F.lit(False)))
    return body.join(head, "sheet").select("sheet", "idx", F.get("cells", F.col("at") - 1).alias("value"))

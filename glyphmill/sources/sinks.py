"""Sinks of finished text and of evidence."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, order: list[str], text: str = "line", mode: str = "errorifexists") -> None:
    """Lines in a total order as files in a folder: the files' names sort as their lines do, and none is made by one task alone."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode(mode).text(path)


def write_marked_text(rows: DataFrame, path: str, order: list[str], text: str = "line", blanks: bool = True) -> int:
    """One UTF-8 file with a byte-order mark and LF ends; the number of lines. A null is an empty line; without `blanks` empty ones are left out.

    For a single work's text: lines come to the driver a partition at a time and are never held whole. The file that was there becomes its backup (.bak).
    """
    target, n = Path(path), 0
    part = target.with_name(target.name + ".part")
    lines = rows.select(*order, F.coalesce(text, F.lit("")).alias(text)) if text not in order else rows
    with part.open("w", encoding="utf-8-sig", newline="\n") as f:
        for row in (lines if blanks else lines.where(F.trim(text) != "")).orderBy(*order).select(text).toLocalIterator():
            f.write(row[0] + "\n")
            n += 1
    if target.exists():
        target.replace(target.with_name(target.name + ".bak"))
    part.replace(target)
    return n


def write_members(rows: DataFrame, path: str, by: str = "name", order: str = "line_no", text: str = "line", mode: str = "errorifexists") -> None:
    """A folder for each member with its lines in order. A member's rows are written by one task, each member apart."""
    rows.repartition(by).sortWithinPartitions(by, order).select(by, text).write.mode(mode).partitionBy(by).text(path)


def write_evidence(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with one object per row; nulls are kept."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_missing(rows: DataFrame, catalog: DataFrame, key: list[str]) -> DataFrame:
    """Catalog and those rows whose key it doesn't have: doing it twice changes nothing."""
    return catalog.unionByName(rows.dropDuplicates(key).join(catalog, key, "left_anti"))

"""Archives as tables: members are rows, found by directory layouts and cut out of the file's bytes.

A file is one row of Spark's `binaryFile` source, so a member never leaves the
task that has its archive; only the directory's rows are spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.codecs import decompress
from glyphmill.functions.lexers import DirectoryEntries, MemberBytes


@dataclass(frozen=True)
class ArchiveLayout:
    """Where the count of members stands, the width of names, the fields (see DirectoryEntries), byte order, codec."""

    start: int
    name_bytes: int
    fields: str
    order: str = "<"
    codec: str = ""
    base: int = 0

    @property
    def declared(self) -> str:
        return f"{self.name_bytes},{self.fields},{self.order}"


#: Layouts of plain directories: count, then records.
LAYOUTS = {"name-offset-size": ArchiveLayout(4, 32, "nos"), "offset-size-name": ArchiveLayout(8, 56, "osn", ">"), "packed": ArchiveLayout(4, 16, "nosr", "<", "zlib")}


def members(files: DataFrame, layout: ArchiveLayout) -> DataFrame:
    """path, name, off, stored, raw, id of files(path, content)."""
    rows = files.lateralJoin(DirectoryEntries(F.col("content").outer(), F.lit(layout.start), F.lit(layout.declared)))
    order = Window.partitionBy("path").orderBy("off", "name")
    return rows.select("path", "name", (F.col("off") + layout.base).alias("off"), "stored", "raw").withColumn("id", F.row_number().over(order) - 1)


def extract(files: DataFrame, layout: ArchiveLayout) -> DataFrame:
    """The columns of files(path, content, ...) but the content, and name, data, error: every member's bytes, decoded.

    The bytes go to Python once a file, and only those of its members come back.
    """
    rows = files.lateralJoin(MemberBytes(F.col("content").outer(), F.lit(layout.start), F.lit(layout.declared), F.lit(layout.base)))
    rows = rows.drop("content").withColumn("d", decompress(F.col("piece"), F.lit(layout.codec)))
    error = F.when(F.col("short"), "member reaches past the end").otherwise(F.coalesce("d.error", F.when(F.octet_length("d.data") != F.col("raw"), "size differs")))
    return rows.select(*(c for c in files.columns if c != "content"), "name", "d.data", error.alias("error"))


def aligned_offsets(entries: DataFrame, align: int, key: str = "path", order: str = "id", size: str = "stored") -> DataFrame:
    """entries with `off`: members in the order of their ids, each after the aligned end of the one before."""
    padded = F.ceil(F.col(size) / align) * align
    return entries.withColumn("off", F.coalesce(F.sum(padded).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def join_segments(pieces: DataFrame, key: list[str], order: str = "pos", data: str = "data") -> DataFrame:
    """key, data: ordered pieces of a member put together (as hex, which concatenates in order)."""
    own = F.array_sort(F.collect_list(F.struct(order, F.hex(data).alias("h"))))
    return pieces.groupBy(*key).agg(F.unhex(F.array_join(own["h"], "")).alias(data))


def records(files: DataFrame, width: int, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """path, record, and a binary column per field (start, length) of files of fixed-width records."""
    n = F.floor(F.octet_length("content") / width).cast("int")
    rows = files.where(F.octet_length("content") >= width).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("record"))
    own = [F.expr(f"substring(content, record * {width} + {a + 1}, {k})").alias(f) for f, (a, k) in fields.items()]
    return rows.select("path", "record", *own)


def raw_sectors(files: DataFrame) -> DataFrame:
    """path, record, data: 2352-byte sectors to their 2048 bytes, by the mode in byte 15."""
    rows = records(files, 2352, {"mode": (15, 1), "one": (16, 2048), "two": (24, 2048)})
    return rows.select("path", "record", F.when(F.hex("mode") == "02", F.col("two")).otherwise(F.col("one")).alias("data"))

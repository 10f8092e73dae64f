"""Character ledgers: what characters a corpus holds, and which are not approved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def charset(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, ch, n, first_line: counted from each line's own characters, so most of the work is done before the shuffle."""
    by = by or []
    chars = rows.select(*by, "line_no", F.explode(F.split("line", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy(*by, "ch").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def with_context(ledger: DataFrame, rows: DataFrame, width: int = 20) -> DataFrame:
    """ledger(ch, n, first_line) with `context`: up to `width` characters on both sides of the character in the line where it stands first (of equal line numbers the smallest line).

    A ledger without groups has at most a row per code point, so it is broadcast; rows whose number is nobody's first line drop out there.
    """
    first = F.broadcast(ledger.select("ch", F.col("first_line").alias("line_no")))
    lines = rows.select("line_no", "line").join(first, "line_no").where(F.col("line").contains(F.col("ch")))
    at = F.instr("line", F.col("ch"))
    begin = F.greatest(at - width, F.lit(1))
    context = F.substring("line", begin, at + width - begin + 1)
    return ledger.join(lines.groupBy("ch").agg(F.min(F.struct("line", context.alias("context")))["context"].alias("context")), "ch", "left")


def fresh(ledger: DataFrame, approved: DataFrame) -> DataFrame:
    """The ledger's characters that `approved` (ch) doesn't have."""
    return ledger.join(approved.select("ch").distinct(), "ch", "left_anti")


def conservation(before: DataFrame, after: DataFrame, value: str = "line") -> DataFrame:
    """value, want, got of values that occur less often afterwards."""
    want, got = before.groupBy(value).agg(F.count("*").alias("want")), after.groupBy(value).agg(F.count("*").alias("got"))
    return want.join(got, value, "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < want")


def byte_histogram(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, byte, n of a binary column; counted from each row's own bytes first."""
    pairs = files.select(key, F.explode(F.regexp_extract_all(F.hex(content), F.lit("(..)"), 1)).alias("h"))
    return pairs.groupBy(key, "h").agg(F.count("*").alias("n")).select(key, F.conv("h", 16, 10).cast("int").alias("byte"), "n")


def row_closure(segments: DataFrame, rows: DataFrame, extras: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, want, got of documents whose rows aren't their segments, pages of several segments, and extras together. segments: key, page."""
    pages = segments.groupBy(key, "page").agg(F.count("*").alias("k")).groupBy(key).agg((F.sum("k") + F.count_if(F.col("k") > 1)).alias("want"))
    if extras is not None:
        more = extras.groupBy(key).agg(F.count("*").alias("more"))
        pages = pages.join(more, key, "full").select(key, (F.coalesce("want", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("want"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    both = pages.join(rows.groupBy(key).agg(F.count("*").alias("got")), key, "full").select(key, zero("want"), zero("got"))
    return both.where("want <> got")

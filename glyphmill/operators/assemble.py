"""Events to segments, pages and output lines.

An event stream has a key, an order, a kind and a text.  Boundary events close the
segment or the page they stand in; running sums number both, and ordered string
aggregation makes their texts.  Layouts are data: which kinds close what.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Kinds of events: `text` adds text, `segment` and `page` close what is open, `newline` adds nothing."""

    text: tuple[str, ...] = ("text",)
    segment: tuple[str, ...] = ("wait",)
    page: tuple[str, ...] = ("clear",)
    joiner: str = ""


#: Boundary events of some script families; fixed values of their formats.
LAYOUTS = {
    "kag": Layout(("text",), ("l", "s"), ("p", "np", "er", "cm", "ct")),
    "nscripter": Layout(("text",), ("@",), ("\\",)),
    "percent": Layout(("text",), ("%K",), ("%P", "%p", "%N", "%V")),
    "renpy": Layout(("text",), ("say",), ("label", "nvl clear")),
    "rpg": Layout(("401",), ("101",), ("102", "0")),
}


def segments(events: DataFrame, layout: Layout, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """key, page, segment (both from 1, gapless), text, first_pos. Empty segments and pages don't count."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    closes = lambda kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("long")).over(before), F.lit(0))
    rows = events.withColumn("p", closes(layout.page)).withColumn("s", closes(layout.segment + layout.page))
    rows = rows.where(F.col("kind").isin(*layout.text) & (F.col("text") != ""))
    own = F.array_sort(F.collect_list(F.struct(order, "text")))
    rows = rows.groupBy(key, "p", "s").agg(F.array_join(own["text"], layout.joiner).alias("text"), F.min(order).alias("first_pos"))
    page = F.dense_rank().over(Window.partitionBy(key).orderBy("p"))
    segment = F.row_number().over(Window.partitionBy(key, "p").orderBy("s"))
    return rows.select(key, page.cast("long").alias("page"), segment.cast("long").alias("segment"), "text", "first_pos")


def dual_lines(segs: DataFrame, key: str = "doc_id", joiner: str = "") -> DataFrame:
    """key, line_no, kind, page, text: every segment, and after those of a page of several the merged page."""
    own = F.array_sort(F.collect_list(F.struct("segment", "text")))
    pages = segs.groupBy(key, "page").agg(own.alias("own"))
    merged = F.struct(F.lit(None).cast("long").alias("segment"), F.array_join(F.col("own")["text"], joiner).alias("text"))
    listed = F.when(F.size("own") > 1, F.concat("own", F.array(merged))).otherwise(F.col("own"))
    rows = pages.select(key, "page", F.posexplode(listed).alias("at", "row"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("page", "at"))
    return rows.select(key, n.cast("long").alias("line_no"), F.when(F.col("row.segment").isNull(), "page").otherwise("segment").alias("kind"), "page", "row.text")


def page_maps(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, map: the JSON page map of the dual lines (pages of several segments)."""
    rows = dual_lines(segs, key)
    pages = rows.groupBy(key, "page").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "segment", F.col("line_no")))).alias("segments"), F.max(F.when(F.col("kind") == "page", F.col("line_no"))).alias("merged")
    )
    pages = pages.where("merged is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("segments", "merged"))).alias("pages"))
    return pages.select(key, F.to_json(F.struct("pages")).alias("map"))


PAGE_MAP = "struct<pages:array<struct<segments:array<int>,merged:int,source:string,merged_text:string>>>"


def validate_page_maps(maps: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, error: each way in which a page map (key, map) disagrees with the lines (key, line_no, line)."""
    lines = lines.select(key, "line_no", "line")
    pages = maps.select(key, F.from_json("map", PAGE_MAP).alias("m")).select(key, F.posexplode_outer("m.pages").alias("page", "p"))
    count = lines.groupBy(key).agg(F.max("line_no").alias("n"))
    pages = pages.join(count, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    s, m = F.col("p.segments"), F.col("p.merged")
    rising = F.forall(F.transform(s, lambda x, i: (i == 0) | (x == F.get(s, i - 1) + 1)), lambda b: b)
    cases = [
        (F.col("p").isNull(), "no pages"),
        (s.isNull() | m.isNull() | F.coalesce(F.exists(s, lambda x: x.isNull()), F.lit(False)), "not integers"),
        (F.size(s) < 2, "fewer than two segments"),
        (~rising, "segments not contiguous"),
        ((F.array_min(s) < 1) | (m > F.col("n")), "out of range"),
        (m != F.element_at(F.when(F.size(s) > 0, s), -1) + 1, "merged line not after the last segment"),
    ]
    error = F.when(cases[0][0], cases[0][1])
    for when, label in cases[1:]:
        error = error.when(when, label)
    pages = pages.withColumn("error", error)
    sound = pages.where("error is null")
    used = sound.select(key, "page", F.explode(F.concat(s, F.array(m))).alias("line_no"))
    twice = used.groupBy(key, "line_no").agg(F.count("*").alias("k"), F.max("page").alias("page")).where("k > 1").select(key, "page", F.lit("line used twice").alias("error")).distinct()
    text = sound.select(key, "page", "p.merged", "p.merged_text", F.explode(s).alias("line_no")).join(lines, [key, "line_no"])
    joined = text.groupBy(key, "page", "merged", "merged_text").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "").alias("joined"))
    wrong = joined.join(lines.select(key, F.col("line_no").alias("merged"), F.col("line").alias("got")), [key, "merged"]).where(F.col("got") != F.coalesce("merged_text", "joined"))
    wrong = wrong.select(key, "page", F.lit("merged text differs").alias("error"))
    return pages.where("error is not null").select(key, "page", "error").unionByName(twice).unionByName(wrong)


def with_speakers(events: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """events with `speaker`: the name set by the last `name` event; an empty name clears it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    name = F.last(F.when(F.col("kind") == "name", F.coalesce("text", F.lit(""))), ignorenulls=True).over(w)
    return events.withColumn("speaker", F.nullif(name, F.lit("")))

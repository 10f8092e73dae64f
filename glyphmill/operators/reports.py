"""Reports and notes in Markdown: front matter, headings, links, declarations, inferred names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.lines import fence_state, lines

#: Keys of reports in both spellings.
ALIASES = {"rows": "rows", "行数": "rows", "title": "title", "作品": "title", "layout": "layout", "版式": "layout"}


def front_matter(c: Column, aliases: Mapping[str, str] = ALIASES) -> Column:
    """A map of the `key: value` lines between the first two lines of dashes; the first of equal keys stays."""
    head = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[^:]+:"))
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    parsed = F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v")))
    named = F.transform(parsed, lambda p: F.struct(F.coalesce(F.try_element_at(names, p["k"]), p["k"]).alias("k"), p["v"].alias("v")))
    once = F.aggregate(named, F.array().cast("array<struct<k:string,v:string>>"), lambda a, p: F.when(F.exists(a, lambda q: q["k"] == p["k"]), a).otherwise(F.concat(a, F.array(p))))
    return F.map_from_entries(once)


def declared_layouts(c: Column) -> Column:
    """The distinct layouts (single, dual) that lines declare; more than one is a conflict."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?m)^\s*(?:layout|版式)\s*[:：]\s*(single|dual)\s*$"), 1)))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title, anchor of headings outside fences; repeated anchors get -1, -2 and so on."""
    rows = fence_state(lines(docs)).where(~F.col("inside") & F.col("line").rlike(r"^#{1,6}\s"))
    rows = rows.select("doc_id", "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#+\s+(.*)$", 1)).alias("title"))
    rows = rows.withColumn("a", T.slug(F.col("title")))
    n = F.row_number().over(Window.partitionBy("doc_id", "a").orderBy("line_no")) - 1
    return rows.withColumn("n", n).select("doc_id", "line_no", "level", "title", F.when(F.col("n") == 0, F.col("a")).otherwise(F.concat("a", F.lit("-"), F.col("n"))).alias("anchor"))


def links(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, target, anchor of the relative links outside fences."""
    rows = fence_state(lines(docs)).where(~F.col("inside"))
    rows = rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\]\(([^)\s]+)\)"), 1)).alias("to")).where(~F.col("to").rlike("^[a-z]+:"))
    return rows.select("doc_id", "line_no", F.nullif(F.split_part("to", F.lit("#"), F.lit(1)), F.lit("")).alias("target"), F.nullif(F.split_part("to", F.lit("#"), F.lit(2)), F.lit("")).alias("anchor"))


def broken_links(docs: DataFrame) -> DataFrame:
    """links whose document or anchor isn't there. docs: doc_id (a path), text."""
    found = links(docs).withColumn("target", F.coalesce("target", "doc_id"))
    there = found.join(docs.select(F.col("doc_id").alias("target")), "target", "left_anti").select("doc_id", "line_no", "target", "anchor")
    known = headings(docs).select(F.col("doc_id").alias("target"), "anchor")
    lost = found.where("anchor is not null").join(docs.select(F.col("doc_id").alias("target")), "target", "left_semi").join(known, ["target", "anchor"], "left_anti")
    return there.unionByName(lost.select("doc_id", "line_no", "target", "anchor"))


def infer_names(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """doc_id, name, times: of the names that patterns (with one group) find in a document, the one it mentions most."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), 1) for p in patterns])))
    rows = docs.select("doc_id", "text", F.explode(found).alias("name")).where(F.length("name") > 0)
    times = (F.length("text") - F.length(F.replace("text", F.col("name"), F.lit("")))) / F.length("name")
    rows = rows.select("doc_id", "name", times.cast("long").alias("times"))
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("name", "times"), F.struct("times", F.length("name"), "name")).alias("b"))
    return best.select("doc_id", "b.*")


def option_findings(docs: DataFrame, declared: str | None, dual: bool, candidates: DataFrame) -> DataFrame:
    """doc_id, rule_id, severity: what reports declare against what was asked for. candidates: doc_id of texts with joined rows."""
    modes = docs.select("doc_id", declared_layouts(F.col("text")).alias("m")).join(candidates.select("doc_id").distinct().withColumn("c", F.lit(True)), "doc_id", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    want = F.lit(declared).cast("string")
    cases = [
        (F.size("m") > 1, "Q28_layout_conflict", "E"),
        (F.lit(declared is not None) & (F.size("m") == 0), "Q28_layout_missing", "E"),
        (F.lit(declared is not None) & (F.size("m") == 1) & (F.get("m", F.lit(0)) != want), "Q28_layout_mismatch", "E"),
        (F.lit(dual) & ~F.col("c"), "Q27_dual_without_candidates", "W"),
        (F.lit(not dual) & F.col("c"), "Q27_single_with_candidates", "W"),
        (F.lit(declared == "dual" and not dual), "Q25_dual_expected", "E"),
    ]
    hits = F.array(*[F.when(when, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for when, i, s in cases])
    return modes.select("doc_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("doc_id", "h.*")

"""Scripts whose tags stand among the text: messages between breaks, choices, macros that are names; figures that reports declare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tag up to its closing bracket; brackets in quotes don't close it. What is never closed reaches to the end.
TAG = r'<[^">]*+(?:"[^"]*+"?[^">]*+)*+(?:>|\z)'


def without_tags(c: Column) -> Column:
    """A line without its tags."""
    return F.regexp_replace(c, TAG, "")


def _named(name: str) -> str:
    return f"(?i)(?=<{name}\\b){TAG}"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")


def messages(scripts: DataFrame, key: str = "doc_id", text: str = "text", pause: str = "pb", case: str = "case", value: str = "value", comment: str = "//", speaker: str = "＠") -> DataFrame:
    """key, seq, kind, text of scripts(key, text): `message`, the text up to a line with the tag `pause`, and `choice`, the values of `case` tags.

    Lines that are blank or start with the comment mark are no part of the script; others lose their tags, then what stands behind a
    comment mark, and are left out of the message if they name a speaker. The lines of a message are put together without anything between. A
    choice comes where its line stands, before a message that ends there. Messages without text are none; what is left at the end is one.
    """
    rows = scripts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    bare = _stripped(F.col("line"))
    rows = rows.where((bare != "") & ~bare.startswith(comment)).withColumn("ends", F.col("line").rlike(f"(?i)<{pause}\\b"))
    words = _stripped(F.substring_index(without_tags(F.col("line")), comment, 1))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0))).withColumn("words", F.when(~words.startswith(speaker), words).otherwise(""))
    own = F.array_sort(F.collect_list(F.struct("n", "words")))
    said = rows.groupBy(key, "part").agg(_stripped(F.array_join(own["words"], "")).alias("text"), F.max("n").alias("n")).where("text <> ''")
    tags = F.transform(F.regexp_extract_all("line", F.lit(f"({_named(case)})"), 1), lambda t: F.regexp_extract(t, f'{value}\\s*=\\s*"([^"]*)"', 0))
    values = F.transform(F.filter(tags, lambda v: v != ""), lambda v: _stripped(F.regexp_extract(v, '"([^"]*)"', 1)))
    offered = rows.where(F.col("line").rlike(f"(?i)<{case}\\b")).select(key, "n", F.posexplode(values).alias("k", "text"))
    both = offered.select(key, "n", F.lit(0).alias("r"), "k", F.lit("choice").alias("kind"), "text").unionByName(said.select(key, "n", F.lit(1).alias("r"), F.lit(0).alias("k"), F.lit("message").alias("kind"), "text"))
    return both.select(key, F.row_number().over(Window.partitionBy(key).orderBy("n", "r", "k")).cast("long").alias("seq"), "kind", "text")


# Tags that only lay text out, and characters that tell code from text.
LAYOUT_TAGS = r"\[(?:nowait|endnowait|history[^\]]*|r|l|p|cm|ct|er|delay[^\]]*)\]"
CODE = r"""[@;{}"\\<>=`]"""


def name_macros(macros: DataFrame) -> DataFrame:
    """name, shown: of macros(name, body) those that do nothing but show a name or a piece of text, and what they show.

    A body shows the text of its `[ch text=...]` if only tags stand beside it; the `f.name` that it sets and embeds, in name brackets; what a macro
    with a bracketed name shows at once (`nowait`); or what is left without tags of layout, if that has no other tags, nothing of code, and not only ASCII.
    """
    body = F.col("body")
    one_line = lambda c: F.trim(F.regexp_replace(c, r"[\r\n]", ""), F.lit(" \t"))
    bare = lambda c: F.regexp_replace(c, r"\[[^\]]*\]", "")
    spoken = F.when(body.rlike(r'\[ch\s+text="[^"]*"\]') & (one_line(bare(body)) == ""), F.regexp_extract(body, r'\[ch\s+text="([^"]*)"\]', 1))
    embeds = body.rlike(r'emb exp="?f\.name') & body.rlike(r"f\.name\s*=\s*'[^']*'")
    embedded = F.when(embeds, F.concat(F.lit("【"), F.regexp_extract(body, r"f\.name\s*=\s*'([^']*)'", 1), F.lit("】")))
    at_once = r"(?s)\[nowait\]\s*(.*?)\s*\[endnowait\]"
    bracketed = F.col("name").startswith("【") & F.col("name").endswith("】") & body.rlike(at_once)
    shown = F.regexp_replace(bare(F.regexp_extract(body, at_once, 1)), r"^[\s　\r\n]+|[\s　\r\n]+$|[\r\n]", "")
    rest = one_line(F.regexp_replace(body, LAYOUT_TAGS, ""))
    plain = F.when(~rest.rlike(r"[\[\]]") & ~rest.rlike(CODE) & rest.rlike(r"[^\x00-\x7F\s　]"), rest)
    # A bracketed macro that shows nothing is no name, whatever else is in its body.
    found = F.when(spoken.isNotNull(), spoken).when(embeds, embedded).when(bracketed, F.when(shown != "", shown)).otherwise(plain)
    return macros.select("name", found.alias("shown")).where("shown IS NOT NULL")


# The unit of rows, and words of lines that declare the finished text.
ROWS_UNIT, FINISHED = "行", ("成品", "全文本", "交付", "txt", "输出")


def declared_rows(reports: DataFrame, key: str = "doc_id", text: str = "text", unit: str = ROWS_UNIT, finished: Sequence[str] = FINISHED) -> DataFrame:
    """key, rows: the number of rows that a report declares: digits with commas, or four to seven without, before the unit.

    One on a line about the finished text counts most, then one in bold, then the first. Reports that declare none aren't there.
    """
    number = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|(?<![0-9,])[0-9]{4,7})"
    lines = reports.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).where(F.col("line").contains(unit))
    hits = lines.select(key, "n", "line", F.posexplode(F.regexp_extract_all("line", F.lit(rf"((?:\*\*.??)?{number}\s*{unit})"), 1)).alias("k", "hit"))
    about = F.lit(False)
    for word in finished:
        about = about | F.col("line").contains(word)
    score = F.when(about, 3).otherwise(0) + F.col("hit").startswith("**").cast("int")
    best = F.max_by("hit", F.struct(score.alias("score"), (-F.col("n")).alias("n"), (-F.col("k")).alias("k")))
    found = hits.groupBy(key).agg(best.alias("hit"))
    return found.select(key, F.replace(F.regexp_extract("hit", f"({number})", 1), F.lit(","), F.lit("")).cast("long").alias("rows"))


def with_full_name(c: Column, surname: str, given: str, form: str = "#NAME[%d]") -> Column:
    """A row with the player's surname and given name in their places, and without line ends."""
    return F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("")), F.lit(form % 1), F.lit(surname)), F.lit(form % 2), F.lit(given))

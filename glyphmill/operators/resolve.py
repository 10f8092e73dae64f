"""Names, placeholders, orders and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.lines import each_document
from glyphmill.session import durable


def fill_references(rows: DataFrame, values: DataFrame, key: list[str], text: str, pattern: str = r"\{(\w+)\}", form: str = "{%s}") -> DataFrame:
    """rows with references filled from values(name, value), and `unresolved`: the names that aren't there (they stay)."""
    refs = rows.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).alias("name"))
    found = refs.join(values.select("name", "value"), "name", "left").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value")))).alias("pairs"), F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("name")))).alias("unresolved")
    )
    left, right = form.split("%s")
    filled = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<name:string,value:string>>")), F.col(text), lambda t, p: F.replace(t, F.concat(F.lit(left), p["name"], F.lit(right)), p["value"]))
    return rows.join(found, key, "left").withColumn(text, filled).withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>"))).drop("pairs")


def expand_macros(macros: DataFrame, pattern: str = r"\[(\w+)\]", form: str = "[%s]") -> DataFrame:
    """name, body of macros(name, body) with the macros in the bodies expanded; calls that lead back to themselves, and unknown ones, stay.

    Each round fills in the macros whose own bodies call no other, so there are as many rounds as levels.
    """
    left, done = durable(macros.select("name", "body")), []
    while True:
        calls = left.select("name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), 1))).alias("call"))
        # A call counts while its macro isn't done.
        waiting = calls.join(left.select(F.col("name").alias("call")), "call", "left_semi").select("name").distinct()
        leaves = durable(left.join(waiting, "name", "left_anti"))
        if leaves.isEmpty():
            break
        done.append(leaves)
        rest = left.join(leaves.select("name"), "name", "left_anti")
        rest = rest.withColumnRenamed("name", "_own")
        left = durable(fill_references(rest, leaves.select("name", F.col("body").alias("value")), ["_own"], "body", pattern, form).select(F.col("_own").alias("name"), "body"))
    out = left
    for part in done:
        out = out.unionByName(part)
    return out


def variant_union(rows: DataFrame, key: list[str], variant: str, text: str) -> DataFrame:
    """key, text, variants: each different text of a key once, with the sorted variants that have it."""
    return rows.groupBy(*key, text).agg(F.sort_array(F.collect_set(variant)).alias("variants"))


def slot_values(events: DataFrame, key: str, order: str) -> DataFrame:
    """events(key, order, op, slot, text) of op `print` with `value`: what set and append left in the slot before, or null.

    A slot's value is the texts since its last set, put together in order. They are put together once for each set; a print takes
    as much from the front as stood there by then.
    """
    w = Window.partitionBy(key, "slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_age", F.sum((F.col("op") == "set").cast("long")).over(w))
    own = Window.partitionBy(key, "slot", "_age").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("op") != "print", F.col("text"))
    rows = rows.withColumn("_upto", F.sum(F.length(said)).over(own))
    whole = rows.where(said.isNotNull()).groupBy(F.col(key).alias("_key"), F.col("slot").alias("_slot"), F.col("_age").alias("_set")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))["t"], "").alias("_whole")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("slot").eqNullSafe(F.col("_slot")) & F.col("_age").eqNullSafe(F.col("_set"))
    prints = rows.where("op = 'print'").join(whole, same, "left")
    return prints.withColumn("value", F.expr("substring(_whole, 1, cast(_upto as int))")).select(*events.columns, "value")


def in_listed_order(rows: DataFrame, order: DataFrame, name: str) -> DataFrame:
    """rows with `rank` from order(name, rank); names that aren't listed come last, by name."""
    return rows.join(order.select(name, "rank"), name, "left").withColumn("rank", F.coalesce("rank", F.lit(2**31 - 1)))


def running_numbers(rows: DataFrame, file: str, order: str, name: str = "number") -> DataFrame:
    """rows numbered from 1 through all files in order; no task sees all rows, nor a row of every file."""
    return numbered(rows, [F.col(file), F.col(order)], name)


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """rows numbered from 1 in a total order: dealt by ranges into a written table, numbered in each range, and moved by the ranges before it. No task sorts all rows."""
    parts = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = parts.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    starts = counts.select("_range", before.alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_own", "_start", "_range")


def numbered_within(rows: DataFrame, key: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """rows numbered from 1 within each key in order; nulls are a key of their own. No task sorts a whole key.

    They are dealt by ranges into a written table, numbered in each range, and moved by what the ranges before hold of the key. Only a
    key that goes on from one range to the next is moved: a row for each range at most.
    """
    by = [F.col(k) for k in key]
    parts = durable(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = parts.groupBy("_range", *key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("_range").alias("_at"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(key)), before.alias("_start")).where("_start IS NOT NULL")
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    moved = parts.withColumn("_own", own).join(F.broadcast(starts), same, "left")
    return moved.withColumn(name, (F.coalesce("_start", F.lit(0)) + F.col("_own")).cast("long")).select(*(F.col(f"`{c}`") for c in rows.columns if c != name), name)


def insert_options(lines: DataFrame, options: DataFrame, key: str) -> DataFrame:
    """key, line_no, kind, text: options(key, page, idx, text) before the lines(key, page, idx, text) of their page."""
    both = options.select(key, "page", F.lit(0).alias("r"), "idx", "text").unionByName(lines.select(key, "page", F.lit(1).alias("r"), "idx", "text"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("page", "r", "idx"))
    return both.select(key, n.cast("long").alias("line_no"), F.when(F.col("r") == 0, "option").otherwise("line").alias("kind"), "text")


def replace_trailing(rows: DataFrame, fresh: DataFrame, mark: Column, key: str = "doc_id") -> DataFrame:
    """rows without their old trailing block of marked rows, and the fresh rows after the rest; doing it twice changes nothing."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    rest = rows.withColumn("_plain", F.sum((~mark).cast("long")).over(w)).where(~mark | (F.col("_plain") > 0)).drop("_plain")
    last = rest.groupBy(key).agg(F.max("line_no").alias("_last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    added = fresh.join(last, key, "left").withColumn("_n", n).withColumn("line_no", F.coalesce("_last", F.lit(0)) + F.col("_n"))
    return rest.unionByName(added.select(*rest.columns))


def labelled_blocks_last(rows: DataFrame, label: Column, moved: list[str], key: str = "doc_id") -> DataFrame:
    """rows renumbered with the blocks of the given labels, in the given order, after all others. A block begins at its label row."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, moved)), F.last(label, ignorenulls=True).over(w)), F.lit(0))
    n = F.row_number().over(Window.partitionBy(key).orderBy("_rank", "line_no"))
    return rows.withColumn("_rank", rank).withColumn("line_no", n.cast("long")).drop("_rank")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def greedy_sentences(rows: DataFrame, most: int = 400, ends: str = "。．.!?！？」』）)】", key: str = "doc_id") -> DataFrame:
    """key, line_no, line: lines joined until one ends a sentence or the joined text reaches `most` characters."""

    def run(numbers: list[int], lines: list[str]) -> list[tuple[int, str]]:
        out, held, size, at = [], [], 0, None
        for n, line in zip(numbers, lines):
            at = n if at is None else at
            held.append(line)
            size += len(line)
            # The last character that isn't blank, in this line or in one before.
            last = next((x[-1:] for y in reversed(held) if (x := y.rstrip())), "")
            if last in tuple(ends) or size >= most:
                out.append((at, "".join(held)))
                held, size, at = [], 0, None
        if size:
            out.append((at, "".join(held)))
        return out

    return each_document(rows, run, key)


def transcribed(rows: DataFrame, transcripts: DataFrame, by: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """rows with the `text` of transcripts(by, text) and `missing`, and a report (by, n) of ids that have no text.

    A row without one keeps its place, with a mark that names the id; blank texts count as none. Of several texts of one id the smallest counts.
    Rows without an id have nothing to look up: null, not missing.
    """
    own = transcripts.where(F.trim(text) != "").groupBy(by).agg(F.min(text).alias("_text"))
    found = rows.join(own, by, "left").withColumn("missing", F.col(by).isNotNull() & F.col("_text").isNull())
    found = found.withColumn(text, F.when(F.col("missing"), F.concat(F.lit("[missing "), F.col(by).cast("string"), F.lit("]"))).otherwise(F.col("_text"))).drop("_text")
    return found, found.where("missing").groupBy(by).agg(F.count("*").alias("n"))


def excluded(rows: DataFrame, rules: Sequence[tuple[str, str, str]], keep: str | None = None) -> DataFrame:
    """rows with `reason`: that of the first of rules(column, pattern, reason) that fits, unless the expression `keep` holds; null stays.

    A null column fits no pattern.
    """
    first = F.coalesce(*(F.when(F.col(column).rlike(pattern), F.lit(reason)) for column, pattern, reason in rules), F.lit(None).cast("string"))
    return rows.withColumn("reason", first if keep is None else F.when(~F.coalesce(F.expr(keep), F.lit(False)), first))

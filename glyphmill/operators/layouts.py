"""Layout variants of the same source: which pages to keep so that each atom comes once, and what the others are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import durable

#: Rows that a task holds about: the number of partitions follows the rows, so a task's memory doesn't.
ROWS_A_TASK = 500_000


def _parts(rows: DataFrame) -> int:
    """Partitions for about `ROWS_A_TASK` rows each, and not fewer than there are cores."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def cover(atoms: DataFrame) -> DataFrame:
    """page, size, status, parts of atoms(page, atom): a greedy cover by pages that share nothing, the smallest first (of equal ones the smallest page).

    `kept` pages share no atom with each other.  A page that isn't kept is `alternate` if kept pages make it up exactly: each of those that
    share an atom with it lies inside it, and together they have all its atoms (`parts`, in order).  Else it is `unproven`: its atoms
    aren't all kept, or a kept page reaches beyond it.  Repeated atoms of a page count once; null atoms and pages are none.

    A page is decided once all smaller pages that share an atom with it are, so a round takes every page that is the smallest at all of its atoms:
    rounds are as many as the longest chain of such pages.  An atom of many pages is a minimum over them; no pairs of pages are made.
    Sizes go with the rows, so nothing is joined by part, where the atoms that no page keeps would be one key.
    """
    rows = atoms.select("page", "atom").where("page IS NOT NULL AND atom IS NOT NULL")
    distinct = rows.repartition(_parts(rows), "page").distinct()
    own = open_ = durable(distinct.withColumn("size", F.count("*").over(Window.partitionBy("page"))))
    place = F.struct("size", "page")
    kept = None
    while kept is None or not open_.isEmpty():
        n = _parts(open_)
        by_atom, by_page = open_.repartition(n, "atom"), open_.repartition(n, "page")
        first = by_atom.groupBy("atom").agg(F.min(place).alias("first"))
        # Tables of one row per key are looked up, so rows of the other side are neither sorted nor held.
        told = by_atom.join(first.hint("shuffle_hash"), "atom").select("page", (F.col("first") == place).alias("at_first"))
        leads = told.repartition(n, "page").groupBy("page").agg(F.min("at_first").alias("leads")).where("leads").select("page")
        taken = durable(by_page.join(leads.hint("shuffle_hash"), "page", "left_semi"))
        met = taken.select("atom").repartition(n, "atom")
        gone = by_atom.join(met.hint("shuffle_hash"), "atom", "left_semi").select("page").repartition(n, "page").distinct()
        open_ = durable(by_page.join(gone.hint("shuffle_hash"), "page", "left_anti"))
        kept = taken if kept is None else kept.unionByName(taken)
    kept, n = durable(kept), _parts(own)
    chosen = kept.select("page", "size").repartition(n, "page").distinct()
    others = own.repartition(n, "page").join(chosen.hint("shuffle_hash"), "page", "left_anti")
    by = kept.select("atom", F.col("page").alias("part"), F.col("size").alias("whole")).repartition(n, "atom")
    met = others.repartition(n, "atom").join(by.hint("shuffle_hash"), "atom", "left")
    shared = met.repartition(n, "page").groupBy("page", "size", "part", "whole").agg(F.count("*").alias("shared"))
    inside = F.min(F.coalesce(F.col("shared") == F.col("whole"), F.lit(False)))
    proven = shared.groupBy("page", "size").agg(inside.alias("inside"), F.sort_array(F.collect_list("part")).alias("parts"))
    proven = proven.select("page", "size", F.when(F.col("inside"), "alternate").otherwise("unproven").alias("status"), F.when(F.col("inside"), F.col("parts")).alias("parts"))
    return chosen.select("page", "size", F.lit("kept").alias("status"), F.lit(None).cast(proven.schema["parts"].dataType).alias("parts")).unionByName(proven)

"""Source divergence audit: how far the word use of the sources of each language lies apart, by an inverted index of corrections.

A term's share p in a group (language, source) is smoothed and scaled to whole numbers, and two
groups differ in a term by f(p, q) = floor((p - q)^2 / (p + q)).  Summed over all kept terms of the language
this is what a pair of sources is told by.  Most terms are missing from most sources, so a pair starts at
V * f(z, z'), where z is the share of a count of nothing, and an index of postings (term to
sources) emits only what differs from that:

- a term that one source of the pair has: f(p, z') - f(z, z').  It depends on the count alone, so terms
  of equal count are one row with a multiplicity, and no row is made for each term and pair;
- a term that both have: what is left after both corrections of the line above.

All sums are of 64-bit integers (the products by decimals), so the order of adding tells nothing.

Texts are cut in tasks that add up terms by group before anything is shuffled, so a hot source costs a task no more
rows than it has terms.  Nothing is collected; a posting is at most as long as a language has sources.

Defined results: null text, lang and source are ''; rows are documents, also with repeated or null doc_ids; a group
without terms has the share of a count of nothing for each term; a language without kept terms has pairs of value 0
and no terms; a language of one source has no pairs; no documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import LOWER, UPPER, Scratch, slices

#: Every byte outside terms is a blank, A-Z are lower-cased, a-z and bytes of other characters stay.
_TERMS = bytes(c if c >= 128 else ord(LOWER[UPPER.index(chr(c))]) if chr(c) in UPPER else c if chr(c) in LOWER else 32 for c in range(256))
#: Terms that a task holds before it hands on what it has added up.
HELD = 500_000
#: Sources of one language that a bucket holds when all of them are met by a row.
SOURCES = 1000


def counted(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: sums by task. Each group that occurs has a row of the term '' as well."""

    def rows(held: dict) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            for column, x in zip(out, ([lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [docs[t] for t in terms])):
                column += x
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        cols = [pa.array(x, kind) for x, kind in zip(out, kinds)]
        cols[2] = cols[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for some in slices(batch):
                groups = zip(some.column("lang").to_pylist(), some.column("source").to_pylist())
                for group, text in zip(groups, some.column("text").cast(pa.binary()).to_pylist()):
                    n, docs = held.setdefault(group, (Counter(), Counter()))
                    terms = text.translate(_TERMS).split()
                    n.update(terms)
                    docs.update(set(terms))
                if sum(len(n) + 4 for n, _ in held.values()) > HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    plain = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(n: str, total: str, unit: int):
    """1 + floor(unit * (n + 2) / (total + 2 * v)), exact for counts of any size; null where a language has no terms."""
    return F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * CAST({unit} AS DECIMAL(12, 0))) div CAST(nullif({total} + 2 * v, 0) AS DECIMAL(20, 0))")


def _apart(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def _met(rows: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Each of `rows` (lang, source, ...) with every other source (item, zi) of its language, in buckets of sources."""
    others = sources.select("lang", F.col("source").alias("item"), F.col("z").alias("zi"), F.pmod(F.xxhash64("source"), F.lit(buckets)).alias("bucket"))
    dealt = rows.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return dealt.join(others, ["lang", "bucket"]).where("source <> item")


def audit(documents: DataFrame, least: int = 10, top: int = 10, unit: int = 1_000_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the language (part `pair`) and the `top` terms that a source uses more than its language (part `term`).

    Kept are the terms in at least `least` documents of the language.
    """
    scratch = Scratch(documents.sparkSession)
    counts = scratch.table(counted(documents).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    posting = Window.partitionBy("lang", "term")
    kept = counts.where("term <> ''").select("lang", "source", "term", "n", F.sum("docs").over(posting).alias("docs"), F.sum("n").over(posting).alias("n_lang"))
    kept = scratch.table(kept.where(F.col("docs") >= least).drop("docs"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.countDistinct("term").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = counts.where("term = ''").select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    #: lang, source, total, total_lang, v, z: a row for each group, with the share of a count of nothing.
    sources = scratch.table(sources.na.fill(0, ["total", "total_lang", "v"]).withColumn("z", _share("0", "total", unit)))
    shares = kept.join(sources, ["lang", "source"]).withColumn("p", _share("n", "total", unit))

    buckets = 1 + sources.count() // SOURCES
    start = _met(sources.select("lang", "source", "z", "v"), sources, buckets).where("source < item").select("lang", "source", "item", F.expr(f"coalesce(v * ({_apart('z', 'zi')}), 0)").alias("x"))
    alike = shares.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("k"))
    one = _met(alike, sources, buckets).select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), F.expr(f"k * ({_apart('p', 'zi')} - {_apart('z', 'zi')})").alias("x"))
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pi"), F.col("z").alias("zi"))
    rest = " ".join((_apart("p", "pi"), "-", _apart("p", "zi"), "-", _apart("z", "pi"), "+", _apart("z", "zi")))
    both = shares.select("lang", "term", "source", "p", "z").join(other, ["lang", "term"]).where("source < item").select("lang", "source", "item", F.expr(rest).alias("x"))
    pairs = start.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))
    each = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", each.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    terms = shares.withColumn("q", _share("n_lang", "total_lang", unit)).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, terms)]
    return scratch.last(ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)))

"""Archives inside archives: members are cut out round by round until none is an archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import durable
from glyphmill.sources.archives import ArchiveLayout, extract


def _starts(content: Column, magic: str) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, len(magic) // 2)) == magic.upper(), F.lit(False))


def descend(files: DataFrame, layouts: Sequence[tuple[str, ArchiveLayout]]) -> DataFrame:
    """path, name, depth, data, error of all members at any depth that aren't archives, of files(path, content).

    layouts: the signature in hex at an archive's start, and its layout; the first that fits counts. The path of a member's archive is that of
    the file and, behind a `!` each, the names of the archives in between. A round a level: what a round finds is written, and
    only archives go on to the next. An archive that holds its own bytes, or those of an archive that it lies in, ends there
    with an error. Members that couldn't be read keep their error; files that are no archives have no rows, nor have empty archives.
    """
    digest = lambda c: F.sha2(c, 256)
    own = lambda c: F.coalesce(*[F.when(_starts(F.col(c), magic), F.lit(k)) for k, (magic, _) in enumerate(layouts)])
    left = files.select("path", "content", F.array(digest(F.col("content"))).alias("above"), own("content").alias("layout")).where("layout IS NOT NULL")
    found, depth = None, 0
    while True:
        depth += 1
        cut = None
        for k, (_, layout) in enumerate(layouts):
            part = extract(left.where(F.col("layout") == k), layout)
            cut = part if cut is None else cut.unionByName(part)
        cut = cut.withColumn("layout", F.when(F.col("error").isNull(), own("data"))).withColumn("again", F.col("layout").isNotNull() & F.array_contains("above", digest(F.col("data"))))
        cut = durable(cut)
        leaf = F.col("layout").isNull() | F.col("again")
        leaves = cut.where(leaf).select("path", "name", F.lit(depth).alias("depth"), "data", F.when(F.col("again"), "holds itself").otherwise(F.col("error")).alias("error"))
        found = leaves if found is None else found.unionByName(leaves)
        inner = cut.where(~leaf)
        if inner.isEmpty():
            return found
        left = inner.select(F.concat("path", F.lit("!"), "name").alias("path"), F.col("data").alias("content"), F.array_append("above", digest(F.col("data"))).alias("above"), "layout")

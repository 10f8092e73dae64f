"""Sharding through fixed virtual slots.

Records are hashed into thousands of slots that never change.  A stored, versioned table
maps slots to shards: version 1 deals them out evenly by number, and each later version edits the
one before for the bytes that the slots hold, moving only slots whose shard is
too heavy or that a new shard needs, and then single slots while that evens out the
heaviest and the lightest shard.  Records find their shard through the last version that is
stored.  The law that holds is `bytes`: shards have nearly equal sizes.  Only the slots' sums,
a fixed number of rows, reach the driver.

The hash is that of the text, so records of equal text share a slot and a shard.  Groups of copies may
hold a third of all rows, which no shard of forty could take whole without breaking the law: a group of more
than `WHOLE` of a shard's fair share (there are shards / WHOLE such groups at most) is salted by a running number
and so spread over several slots.

Positions in a shard come from counts of smaller groups (slot and a cut by doc_id and running
number), so no task sorts a whole shard or a group of copies.  The number of these cuts follows the largest slot; it
decides which position a row gets, and nothing else.

Defined results: a null text has no bytes and the checksum of an empty one, with which it is equal; null
and repeated doc_ids are spread by their text, and by the salt; repeated rows each get a position.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch

SLOTS = 4096
#: Rows of one slot that one sort handles; larger slots are cut by further bits of the hash.
ROWS_A_CUT = 50_000
#: The part of a shard's fair share up to which rows of equal text stay together.
WHOLE = 0.25
MAP_SCHEMA = "version int, slot int, shard int"


def _bytes_of(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def hashed(documents: DataFrame, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, h, rid (a number of the row, for the salt)."""
    text = _bytes_of(F.col("text"))
    rows = documents.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    return rows.withColumn("rid", F.monotonically_increasing_id())


def heavy_hashes(rows: DataFrame, shards: int) -> DataFrame:
    """heavy, salts of the hashes that hold more than WHOLE of a shard's fair share of bytes: shards / WHOLE rows at most. Each salt takes a quarter of a slot's share."""
    total = rows.agg(F.sum("size")).first()[0] or 1
    by = rows.groupBy(F.col("h").alias("heavy")).agg(F.sum("size").alias("own"), F.count("*").alias("k")).where((F.col("own") * shards > total * WHOLE) & (F.col("k") > 1))
    return by.select("heavy", F.least(F.col("k"), F.ceil(F.col("own") * (4.0 * SLOTS / total))).cast("long").alias("salts"))


def with_slots(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows(h, rid, ...) with salted `h` and virtual_slot. What is heavy has shards / WHOLE rows at most and is broadcast."""
    rows = rows.join(F.broadcast(heavy), F.col("h") == F.col("heavy"), "left")
    salted = F.when(F.col("salts").isNotNull(), F.xxhash64("h", F.pmod(F.xxhash64("rid"), F.col("salts")))).otherwise(F.col("h"))
    return rows.withColumn("h", salted).drop("heavy", "salts").withColumn("virtual_slot", F.pmod("h", F.lit(SLOTS)).cast("int"))


def slot_sizes(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(shards: int) -> dict[int, int]:
    """Slot to shard, dealt out in turn."""
    return {slot: slot % shards for slot in range(SLOTS)}


def rebalance(current: dict[int, int], sizes: dict[int, int], shards: int, slack: float = 0.02) -> dict[int, int]:
    """The map edited for new sizes or a new number of shards: slots leave shards above the mean and slack, or that are gone."""
    out, load = dict(current), dict.fromkeys(range(shards), 0)
    homeless = [x for x in sorted(out) if out[x] >= shards]
    for slot, shard in out.items():
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
    mean = sum(sizes.values()) / shards
    for shard in range(shards):
        for slot in sorted((x for x in out if out[x] == shard), key=lambda x: (sizes.get(x, 0), x)):
            if load[shard] <= mean * (1 + slack):
                break
            load[shard] -= sizes.get(slot, 0)
            homeless.append(slot)
    heap = [(n, s) for s, n in load.items()]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda x: (-sizes.get(x, 0), x)):
        n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (n + sizes.get(slot, 0), shard))
    return evened(out, sizes, shards)


def evened(current: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map after moves of single slots from the heaviest shard to the lightest, while one brings the two closer."""
    own: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in current.items():
        if sizes.get(slot, 0):
            own[shard].append(slot)
    load = {s: sum(sizes[x] for x in slots) for s, slots in own.items()}
    out = dict(current)
    for _ in range(SLOTS):
        top, low = max(load, key=lambda s: (load[s], s)), min(load, key=lambda s: (load[s], s))
        gap = load[top] - load[low]
        # The slot whose move leaves the smallest gap.
        best = min((x for x in own[top] if sizes[x] < gap), key=lambda x: (abs(gap - 2 * sizes[x]), x), default=None)
        if best is None:
            break
        own[top].remove(best)
        own[low].append(best)
        load[top], load[low], out[best] = load[top] - sizes[best], load[low] + sizes[best], low
    return out


def map_table(spark: SparkSession, version: int, slots: dict[int, int]) -> DataFrame:
    return spark.createDataFrame([(version, k, v) for k, v in sorted(slots.items())], MAP_SCHEMA)


def save_map(spark: SparkSession, path: str, version: int, slots: dict[int, int]) -> None:
    """Adds a version to the stored maps; earlier ones stay readable."""
    map_table(spark, version, slots).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The stored map of a version, or the last."""
    rows = spark.read.parquet(path)
    version = version if version is not None else rows.agg(F.max("version")).first()[0]
    return version, {r["slot"]: r["shard"] for r in rows.where(F.col("version") == version).collect()}


def edited_map(spark: SparkSession, path: str, sizes: dict[int, int], shards: int) -> tuple[int, dict[int, int]]:
    """The last stored map (version 1 if there is none yet), edited for `sizes`, stored as the next version and read back."""
    if not _stored(spark, path):
        save_map(spark, path, 1, first_map(shards))
    version, slots = load_map(spark, path)
    save_map(spark, path, version + 1, rebalance(slots, sizes, shards, 0.0))
    return load_map(spark, path, version + 1)


def _stored(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def assign(documents: DataFrame, shards: int = 40, path: str | None = None) -> DataFrame:
    """The rows of `documents` with `shard` (in place of a column of this name). Nothing is shuffled but sums by hash and by slot. path: where the maps are stored.

    `documents` is read twice; a written table gives its rows in the same order then, so that salted rows count where they go.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    documents = documents.drop("shard")
    rows = hashed(documents)
    heavy = scratch.table(heavy_hashes(rows, shards))
    totals = slot_sizes(with_slots(rows, heavy)).collect()  # SLOTS rows at most
    version, slots = edited_map(spark, path or f"{scratch.folder}/maps", {r["virtual_slot"]: r["bytes"] for r in totals}, shards)
    where = F.broadcast(map_table(spark, version, slots).select(F.col("slot").alias("virtual_slot"), "shard"))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    own = documents.select(row, F.xxhash64(_bytes_of(F.col("text"))).alias("h"), F.monotonically_increasing_id().alias("rid"))
    return with_slots(own, heavy).join(where, "virtual_slot").select("row.*", "shard")


def shard(documents: DataFrame, shards: int = 40, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (position in the shard), virtual_slot, map_version: a row per row. path: where the maps are stored."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    raw = scratch.table(hashed(documents))
    rows = scratch.table(with_slots(raw, heavy_hashes(raw, shards)))
    scratch.drop(raw)
    totals = slot_sizes(rows).collect()  # SLOTS rows at most
    version, slots = edited_map(spark, path or f"{scratch.folder}/maps", {r["virtual_slot"]: r["bytes"] for r in totals}, shards)
    cuts = -(-max([1, *(r["rows"] for r in totals)]) // ROWS_A_CUT)
    where = F.broadcast(map_table(spark, version, slots).select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version")))
    rows = rows.join(where, "virtual_slot").withColumn("cut", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(cuts)))
    group = ["shard", "virtual_slot", "cut"]
    counts = rows.groupBy(*group).count()
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("nth", nth).join(starts, group).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )

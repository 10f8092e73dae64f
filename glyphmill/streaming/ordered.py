"""Streams whose rows come out of order: rows wait in state until the watermark has passed them, and two streams are joined by time.

The functions on DataFrames take streams with a watermark; `deltas` and `pairs` of (spark, folder) cut the events into
files that overlap in time, run a stream over them file by file, and give back the sink's table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glyphmill.session import shared_folder
from glyphmill.streaming.sampler import run_now

#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Files that the events are cut into.
FILES = 6
#: Buckets of users, each of which has its state as a whole.
BUCKETS = 1024


#: What waits: time in microseconds, event, user, value and whether there is one.
_ROW = np.dtype([("at", "<i8"), ("id", "<i8"), ("user", "<i8"), ("value", "<f8"), ("there", "?")])
#: The last value of a user that went out.
_LAST = np.dtype([("user", "<i8"), ("value", "<f8"), ("there", "?")])


class InOrder(StatefulProcessor):
    """Differences to the user's value before, in the order of time and id, whatever order rows come in.

    A key is a bucket of users. Rows wait in a list of arrays until the watermark has passed them; a timer stands at the earliest
    that waits. The state of a bucket is what came within the watermark's delay, and its users' last values that went out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = []
        for some in rows:
            own = np.zeros(len(some), _ROW)
            # In whole microseconds, so rows of one millisecond keep their order.
            own["at"], own["id"], own["user"] = some["ts"].astype("datetime64[us]").astype("int64"), some["event_id"], some["user_id"]
            own["there"] = some["value"].notna()
            own["value"] = some["value"].fillna(0.0)
            self.waiting.appendValue((own.tobytes(),))
            at.append(int(own["at"].min()))
        if at:
            self._wake(min(at))
        yield self._told(np.zeros(0, _ROW), np.zeros(0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        rows = np.concatenate([np.zeros(0, _ROW), *(np.frombuffer(r[0], _ROW) for r in self.waiting.get())])
        ready, rest = rows[rows["at"] <= passed], rows[rows["at"] > passed]
        if len(ready):
            ready = ready[np.lexsort((ready["id"], ready["at"], ready["user"]))]
            last = np.frombuffer(self.last.get()[0], _LAST) if self.last.exists() else np.zeros(0, _LAST)
            first = np.append(True, ready["user"][1:] != ready["user"][:-1])
            before, there = np.roll(ready["value"], 1), np.roll(ready["there"], 1)
            # A user's first row follows the last that went out, if any did.
            k = np.searchsorted(last["user"], ready["user"][first])
            known = np.append(last["user"], 0)[k] == ready["user"][first]
            known[k == len(last)] = False
            before[first], there[first] = np.append(last["value"], 0.0)[k], np.append(last["there"], False)[k] & known
            yield self._told(ready, np.where(there & ready["there"], ready["value"] - before, np.nan))
            ends = ready[np.append(first[1:], True)]
            old = last[~np.isin(last["user"], ends["user"])]
            new = np.zeros(len(old) + len(ends), _LAST)
            for name in _LAST.names:
                new[name] = np.concatenate([old[name], ends[name]])
            self.last.update((np.sort(new, order="user").tobytes(),))
            self.waiting.clear()
            if len(rest):
                self.waiting.put([(rest.tobytes(),)])
        if len(rest):
            self._wake(int(rest["at"].min()))

    def _told(self, rows: np.ndarray, deltas: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"event_id": rows["id"], "user_id": rows["user"], "delta": deltas})

    def _wake(self, at: int) -> None:
        """Timers count in milliseconds: the first that the row doesn't lie behind."""
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


def ordered_deltas(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """event_id, user_id, delta of a stream events(event_id, user_id, ts, value) with a watermark on ts. What the watermark hasn't passed waits.

    State is asked for and put back by bucket of users, so its calls don't grow with the users.
    """
    events.sparkSession.conf.set(*STORE)
    own = events.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    return own.groupBy("bucket").transformWithStateInPandas(InOrder(), "event_id long, user_id long, delta double", "append", "EventTime")


def followed(left: DataFrame, right: DataFrame, within: str) -> DataFrame:
    """left_id, right_id: a right event of the same user within a time after a left one. Both streams need a watermark, so state older than both may allow is dropped."""
    a = left.select(F.col("event_id").alias("left_id"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    b = right.select(F.col("event_id").alias("right_id"), F.col("user_id").alias("v"), F.col("ts").alias("s"))
    return a.join(b, F.expr(f"u = v AND s >= t AND s <= t + INTERVAL {within}")).select("left_id", "right_id")


def spans(spark: SparkSession, sf_dir: str, files: int = FILES) -> tuple[str, int, int]:
    """Writes the events as folders of files, spans of equal length by time, but of each span a third of the rows comes a folder later, so no folder is in order.

    Gives the path, how many files a folder has at most, and the length of a span in microseconds.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.coalesce(F.min(F.unix_micros("ts")), F.lit(0)).alias("lo"), F.coalesce(F.max(F.unix_micros("ts")), F.lit(0)).alias("hi")).first()
    length = (span["hi"] - span["lo"]) // (files - 1) + 1
    at = F.floor((F.unix_micros("ts") - span["lo"]) / length) + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    base = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    parts = events.rdd.getNumPartitions()
    for k in range(files):
        # Dealt out, so each folder has as many files as any other, in whatever order the table stands.
        own = events.where(at == k)
        (own.repartition(parts) if parts > 1 else own).write.parquet(f"{base}/file={k}")
    return base, parts, length


def folders(spark: SparkSession, sf_dir: str, written: tuple[str, int, int]) -> DataFrame:
    """What spans() wrote as a stream, about one folder each time, however many files it has.

    The watermark lies two spans behind, so no row is late, also where a batch ends inside a folder.
    """
    base, parts, length = written
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(f"{base}/file=*")
    return stream.withWatermark("ts", f"{2 * length // 1_000_000 + 1} seconds")


def overlapping_files(spark: SparkSession, sf_dir: str, files: int = FILES) -> DataFrame:
    """The events as a stream whose batches overlap in time."""
    return folders(spark, sf_dir, spans(spark, sf_dir, files))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, delta of the events that the last watermark has passed."""
    out = run_now(ordered_deltas(overlapping_files(spark, sf_dir).select("event_id", "user_id", "ts", "value")), "append")
    return out.select("event_id", "user_id", F.when(~F.isnan("delta"), F.round("delta", 6)).alias("delta"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """left_id, right_id: purchases within two days after a signup of the same user, from two streams."""
    written = spans(spark, sf_dir)
    left, right = (folders(spark, sf_dir, written).where(F.col("event_type") == kind) for kind in ("signup", "purchase"))
    return run_now(followed(left, right, "2 days"), "append").select("left_id", "right_id")

"""Streams over sampled events: first sightings, hourly counts, counter deltas, correlated watches.

Each function of (spark, folder) runs its stream over what is there now
(`availableNow`), with its checkpoint and its sink in the shared folder, and gives back
the sink's table.  The functions on DataFrames work on streams and on tables alike.
"""

from __future__ import annotations

import uuid
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphmill.session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A watermark needs timestamps with a zone.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_now(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there; a batch that is run again replaces its own output."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, user_id, first_seen: state is kept per pair, and later sightings only update it."""
    grouped = event_stream(spark, sf_dir).groupBy("event_type", "user_id").agg(F.min("ts").alias("first_seen"))
    out = run_now(grouped, "update")
    return out.groupBy("event_type", "user_id").agg(F.min("first_seen").cast("timestamp_ntz").alias("first_seen"))


def unseen(events: DataFrame, by: list[str], lateness: str = "1 hour") -> DataFrame:
    """Events whose value hasn't been seen within `lateness`; older state is dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(by)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """started, event_type, n. The watermark lets hours close; what is still open counts as it stands."""
    counts = event_stream(spark, sf_dir).withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = run_now(counts, "update")
    latest = out.groupBy("w", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return latest.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, delta to the user's value before; the state is one number per user."""
    schema = "event_id long, user_id long, delta double"

    def step(key: tuple, frames, state: GroupState):
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        before = state.get[0] if state.exists else None
        shifted = rows["value"].shift(1)
        if before is not None:
            shifted.iloc[0] = before
        state.update((float(rows["value"].iloc[-1]),))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy("int64"), "user_id": int(key[0]), "delta": (rows["value"] - shifted).round(6).fillna(float("nan")).to_numpy("float64")})

    stream = event_stream(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    stream = stream.groupBy("user_id").applyInPandasWithState(step, schema, "value double", "append", GroupStateTimeout.NoTimeout)
    return run_now(stream, "append").select("event_id", "user_id", F.when(~F.isnan("delta"), F.col("delta")).alias("delta"))


def correlate(left: DataFrame, right: DataFrame, within: str) -> DataFrame:
    """left_id, right_id of a user's events of which the right one follows within a time. For streams, give both a watermark."""
    a = left.select(F.col("event_id").alias("left_id"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    b = right.select(F.col("event_id").alias("right_id"), F.col("user_id").alias("v"), F.col("ts").alias("s"))
    return a.join(b, F.expr(f"u = v AND s >= t AND s <= t + INTERVAL {within}")).select("left_id", "right_id")

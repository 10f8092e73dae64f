"""The sampler's operators on `events`: batch forms, and the streams of `glyphmill.streaming`."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.plans.registry import query, table
from glyphmill.streaming import ordered
from glyphmill.streaming import sampler as streams


@query(
    """WITH w AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM w)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, round(sum(value), 4) AS value FROM g GROUP BY user_id, s"""
)
def session_windows(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes"))
    return rows.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).drop("session_window")


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def counter_delta(spark, d):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") - before, 6).alias("delta"))


@query(
    """WITH w AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS a, ts FROM events), p AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
SELECT event_id, user_id, a - before AS delta, coalesce(a - before >= 4, true) AS starts FROM p WHERE a IS NOT NULL"""
)
def message_starts(spark, d):
    rows = table(spark, d, "events").withColumn("a", F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k").cast("long")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("delta", F.col("a") - F.last("a", ignorenulls=True).over(w)).where("a is not null")
    return rows.select("event_id", "user_id", "delta", F.coalesce(F.col("delta") >= 4, F.lit(True)).alias("starts"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return rows.select("w.start", "event_type", "n", "mean").withColumnRenamed("start", "started")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS decade, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type", F.floor(k / 10).cast("long").alias("decade")).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM e JOIN p ON e.user_id = p.user_id AND p.ts >= e.ts AND p.ts <= e.ts + INTERVAL 2 HOUR"""
)
def correlated_watch(spark, d):
    events = table(spark, d, "events")
    return streams.correlate(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), "2 hours").select(F.col("left_id").alias("error_id"), F.col("right_id").alias("purchase_id"))


@query("SELECT event_type, user_id, min(ts) AS first_seen FROM events GROUP BY ALL")
def stream_dedupe(spark, d):
    return streams.first_seen(spark, d)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    return streams.hourly(spark, d)


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def stream_deltas(spark, d):
    return streams.deltas(spark, d)


@query("SELECT event_id, n_name FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE event_type = 'purchase'")
def stream_candidates(spark, d):
    """A stream joined with a table that each batch reads anew."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return streams.run_now(streams.event_stream(spark, d).where("event_type = 'purchase'").join(people, "user_id").select("event_id", "n_name"), "append").select("event_id", "n_name")


@query(
    """WITH s AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), w AS (SELECT (hi // 1000 - 1000 * (2 * ((hi - lo) // 5 + 1) // 1000000 + 1)) * 1000 AS passed FROM s)
SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events, w WHERE epoch_us(ts) <= passed"""
)
def stream_ordered_deltas(spark, d):
    """Files that overlap in time, in any order within: rows wait for the watermark, and those it hasn't passed at the end still do."""
    return ordered.deltas(spark, d)


@query("""SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""")
def stream_pairs(spark, d):
    """Two streams of files that overlap in time, joined within two days."""
    return ordered.pairs(spark, d)

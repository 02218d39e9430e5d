"""Streaming queries: the events table as a file stream, run until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.core.runtime import scratch, table
from quarry.plans.registry import query
from quarry.streaming import events as S


def stream(spark, d):
    s = S.file_stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("STR_02", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def replay_safe(spark, d):
    return S.run_available(stream(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query("STR_04", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'dlt_malformed' WHEN event_id % 7 = 0 THEN 'dlt_missing_fields' WHEN event_id % 5 = 0 THEN 'skipped_empty' ELSE 'processed' END AS route FROM events")
def routing(spark, d):
    return S.run_available(S.routed(messages(spark, d)).select("event_id", "route"))


def messages(spark, d):
    """The events as envelopes, some broken or incomplete."""
    body = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("raw_payload"), F.lit("2024-01-01").alias("fetched_at"), F.when(F.col("event_id") % 7 != 0, F.md5(F.col("event_id").cast("string"))).alias("source_hash")))
    return stream(spark, d).select("event_id", F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(body).alias("value"))


@query("STR_06", """WITH x AS (SELECT user_id, value < 30 AS f, sum((value >= 30)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), y AS (SELECT *, max(g) OVER (PARTITION BY user_id) AS m FROM x)
SELECT user_id, sum((f AND g = m)::INT)::BIGINT AS consecutive, sum((f AND g = m)::INT) >= 3 AS blacklisted FROM y GROUP BY 1""")
def failures(spark, d):
    at = F.format_string("%020d:%020d", F.unix_micros("ts"), F.col("event_id"))
    return S.run_available(S.keyed_failures(stream(spark, d).select("user_id", (F.col("value") < 30).alias("bad"), at.alias("at")), "user_id", "bad", "at"), "update")


@query("EXT_window", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def windows(spark, d):
    s = stream(spark, d).withWatermark("ts", "1 day").groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return S.run_available(s, "complete").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


_ROUTE = "CASE WHEN event_id % 11 = 0 THEN 'malformed' WHEN event_id % 7 = 0 THEN 'missing_fields' END"


@query("SNK_11", f"SELECT event_id, {_ROUTE} AS reason FROM events WHERE event_id % 11 = 0 OR event_id % 7 = 0")
def dead_letters(spark, d):
    good, dead = scratch(spark, "good"), scratch(spark, "dead")
    S.with_dead_letters(S.routed(messages(spark, d)).select("event_id", "value", "route"), good, dead, scratch(spark, "state"))
    return spark.read.parquet(dead).select("event_id", "reason")


@query("STR_11", "SELECT count(*) AS failed, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_id % 13 = 0")
def failed_publishes(spark, d):
    """Messages whose publication fails come out as dead letters with the error."""
    x = stream(spark, d).select("event_id", F.when(F.col("event_id") % 13 == 0, "dlt_publish_failed").otherwise("processed").alias("route"))
    good, dead = scratch(spark, "good"), scratch(spark, "dead")
    S.with_dead_letters(x, good, dead, scratch(spark, "state"))
    return spark.read.parquet(dead).agg(F.count("*").alias("failed"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("STR_01", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3")
def delivered_once(spark, d):
    """The stream delivered twice to a sink that ignores keys it has: each key once."""
    rows = scratch(spark, "delivered")
    x = stream(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("k"), "event_id", "user_id", "event_type")
    for _ in range(2):
        S.write_once(x, rows, scratch(spark, "state"), "k").awaitTermination()
    return spark.read.parquet(rows).select("event_id", "user_id", "event_type")


@query("STR_03", """SELECT 'dlt_malformed' AS route, count(*) AS n FROM events WHERE event_id % 11 = 0 UNION ALL SELECT 'dlt_missing_fields', count(*) FROM events WHERE event_id % 11 <> 0 AND event_id % 7 = 0
UNION ALL SELECT 'skipped_empty', count(*) FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 = 0 UNION ALL SELECT 'processed', count(*) FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0""")
def end_to_end(spark, d):
    return S.run_available(S.routed(messages(spark, d)).groupBy("route").agg(F.count("*").alias("n")), "complete")


@query("STR_05", "SELECT event_id FROM events WHERE event_id % 11 = 0")
def malformed(spark, d):
    return S.run_available(S.routed(messages(spark, d)).where("route = 'dlt_malformed'").select("event_id"))


@query("STR_07")
def token_bucket(spark, d):
    """Ten requests a minute for each kind of event, burst of 60."""
    x = stream(spark, d).select("event_type", (F.unix_micros("ts") / 1e6).alias("at"), "event_id")
    return S.run_available(S.rate_limited(x, "event_type", "at", 60, 10 / 60))


@query("STR_08", "SELECT CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS run, count(*) AS n FROM events GROUP BY 1")
def incremental(spark, d):
    """Two runs with one checkpoint: the second reads only what came after the first."""
    landing, state, rows = scratch(spark, "landing"), scratch(spark, "state"), scratch(spark, "rows")
    e = table(spark, d, "events").select("event_id")
    for run, part in ((1, "event_id % 2 = 0"), (2, "event_id % 2 = 1")):
        e.where(part).write.mode("append").parquet(landing)
        S.consumed(spark.readStream.schema("event_id long").parquet(landing).withColumn("run", F.lit(run)), rows, state)
    return spark.read.parquet(rows).groupBy("run").agg(F.count("*").alias("n"))


@query("STR_09", "SELECT g AS grp, event_type, count(*) AS n FROM events, (SELECT unnest(['raw', 'graph']) AS g) GROUP BY 1, 2")
def two_groups(spark, d):
    """Two consumer groups over one source, each with its own checkpoint: both see every row."""
    out = None
    for name in ("raw", "graph"):
        rows = scratch(spark, name)
        S.consumed(stream(spark, d).select("event_id", "event_type"), rows, scratch(spark, "state"))
        x = spark.read.parquet(rows).groupBy(F.lit(name).alias("grp"), "event_type").agg(F.count("*").alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


@query("STR_10", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly(spark, d):
    """What an hourly schedule ingests: rows by the hour they belong to, late ones added to it."""
    x = stream(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return S.run_available(x, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


@query("SRC_11", "SELECT event_id, user_id, event_type FROM events")
def raw_group(spark, d):
    rows = scratch(spark, "rows")
    S.consumed(stream(spark, d).select("event_id", "user_id", "event_type"), rows, scratch(spark, "state"))
    return spark.read.parquet(rows)


@query("SRC_12", "SELECT DISTINCT user_id, event_type FROM events")
def graph_group(spark, d):
    rows = scratch(spark, "rows")
    S.consumed(stream(spark, d).select("user_id", "event_type").dropDuplicates(), rows, scratch(spark, "state"))
    return spark.read.parquet(rows)


@query("SRC_13", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def bounded_worker(spark, d):
    """A worker that takes what is there, a bounded number of files at a time, and ends."""
    landing = scratch(spark, "landing")
    table(spark, d, "events").select("event_id", "event_type").repartition(6).write.parquet(landing)
    x = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 2).parquet(landing)
    return S.run_available(x.groupBy("event_type").agg(F.count("*").alias("n")), "complete")

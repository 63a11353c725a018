"""The streaming queries, drained over the events that are there."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from weft.plans.registry import query
from weft.sources import shared_folder, table
from weft.streaming import feeds

#: How late events may come.
_LATE = "10 minutes"


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return feeds.event_time(feeds.follow(spark, d, schema, glob="events.parquet"))


def _drained(spark, df, mode):
    return feeds.drain(df, f"{shared_folder(spark)}/{uuid.uuid4().hex}", mode)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_tumbling(spark, d):
    df = _drained(spark, feeds.tumbling(_stream(spark, d), "ts", "1 hour", _LATE, ["event_type"], "value"), "complete")
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) GROUP BY ALL")
def streaming_sliding(spark, d):
    df = _drained(spark, feeds.sliding(_stream(spark, d), "ts", "2 hours", "1 hour", _LATE, ["event_type"]), "complete")
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def streaming_sessions(spark, d):
    df = _drained(spark, feeds.sessions(_stream(spark, d), "ts", "30 minutes", _LATE, ["user_id"]), "complete")
    return df.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def streaming_dedup(spark, d):
    df = _drained(spark, feeds.once(_stream(spark, d), ["event_id"], "ts", "100 days").select("event_id"), "append")
    return df.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT 'events' AS topic, count(*) AS n FROM events")
def streaming_topic(spark, d):
    df = _drained(spark, feeds.topic(_stream(spark, d).select("event_id", "ts"), "events", "ts"), "append")
    return df.groupBy("topic").agg(F.count("message").alias("n"))


@query("SELECT user_id, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY ALL")
def streaming_actor(spark, d):
    df = _drained(spark, feeds.actors(_stream(spark, d).select("user_id", "value"), "user_id", _step, "n bigint, top double"), "update")
    return df.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max("top"), 6).alias("top"))


def _step(state, rows):
    return {"n": state.get("n", 0) + len(rows), "top": max(state.get("top", float("-inf")), float(rows["value"].max()))}


@query("""WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events WHERE event_id % 2 = 0)
SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events, w WHERE event_id % 2 = 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY ALL""")
def streaming_late(spark, d):
    """All events in two halves, one after the other: of the second half, what comes after the watermark has closed its window is late and left out."""
    e = table(spark, d, "events").select("event_id", "ts")
    top = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{top}/events")
        stream = feeds.event_time(feeds.follow(spark, f"{top}/events", e.schema))
        counts = stream.withWatermark("ts", _LATE).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
        seen = feeds.drain(counts.select(F.col("w.start").alias("start"), "n"), f"{top}/out", "update")
    return seen.groupBy(F.col("start").cast("timestamp_ntz").alias("start")).agg(F.max("n").alias("n"))


@query("SELECT user_id, round(sum(exp(-(m - t) / 3600)), 6) AS weight FROM (SELECT user_id, epoch(ts) AS t, max(epoch(ts)) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY ALL")
def streaming_decay(spark, d):
    """Decaying counts as events come: state is the weight and the time it holds for."""
    e = _stream(spark, d).select("user_id", (F.unix_micros("ts") / 1_000_000).cast("double").alias("t"))
    df = _drained(spark, feeds.actors(e, "user_id", _decay, "weight double, t double"), "update")
    return df.groupBy("user_id").agg(F.round(F.max_by("weight", "t"), 6).alias("weight"))


def _decay(state, rows, span: float = 3600.0):
    last = max(state.get("t", float("-inf")), float(rows["t"].max()))
    kept = state["weight"] * math.exp(-(last - state["t"]) / span) if state else 0.0
    return {"weight": kept + float(np.exp(-(last - rows["t"]) / span).sum()), "t": last}

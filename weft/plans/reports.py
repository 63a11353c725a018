"""Reports over logs of work: memory, transfers, load, durations and errors, by worker and by kind of task.

The log is the table of events: a task is an event, its kind the event's type, its worker the user, its seconds the
value, its bytes ``k`` of the properties. A worker sends to the one whose number follows its own by the bytes of the
transfer, modulo ``PEERS``.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import scalar
from weft.operators import aggregates as agg
from weft.operators import telemetry, windows
from weft.operators.joins import merge
from weft.plans.registry import query
from weft.plans.relational import seconds
from weft.sources import table

#: Workers that one worker sends to.
PEERS = 4
_TASKS = "(SELECT event_id, event_type AS kind, user_id AS worker, value AS secs, epoch(ts) AS start, CAST(json_extract_string(props, '$.k') AS BIGINT) AS bytes FROM events)"


def _tasks(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("worker"), F.col("value").alias("secs"), seconds().alias("start"), F.get_json_object("props", "$.k").cast("bigint").alias("bytes"))


@query(f"SELECT kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM {_TASKS} GROUP BY ALL ORDER BY kind")
def memory_by_key(spark, d):
    return _tasks(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("kind")


@query(f"SELECT CAST(sum(bytes) FILTER (WHERE kind IN ('click', 'view')) AS BIGINT) AS managed, CAST(sum(bytes) FILTER (WHERE kind IN ('purchase', 'signup')) AS BIGINT) AS unmanaged, CAST(sum(bytes) FILTER (WHERE kind = 'error') AS BIGINT) AS spilled, CAST(sum(bytes) AS BIGINT) AS process FROM {_TASKS}")
def cluster_memory(spark, d):
    return _tasks(spark, d).agg(*(F.sum(F.when(F.col("kind").isin(*kinds), F.col("bytes"))).alias(name) for name, kinds in _MEMORY.items()), F.sum("bytes").alias("process"))


_MEMORY = {"managed": ("click", "view"), "unmanaged": ("purchase", "signup"), "spilled": ("error",)}


@query(f"SELECT worker, coalesce(CAST(sum(bytes) FILTER (WHERE kind IN ('click', 'view')) AS BIGINT), 0) AS managed, coalesce(CAST(sum(bytes) FILTER (WHERE kind IN ('purchase', 'signup')) AS BIGINT), 0) AS unmanaged, coalesce(CAST(sum(bytes) FILTER (WHERE kind = 'error') AS BIGINT), 0) AS spilled FROM {_TASKS} GROUP BY worker")
def workers_memory(spark, d):
    return _tasks(spark, d).groupBy("worker").agg(*(F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("bytes"))), F.lit(0)).alias(name) for name, kinds in _MEMORY.items()))


_HISTOGRAM = "WITH w AS ({}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM w) SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM w, e GROUP BY ALL"


@query(_HISTOGRAM.format(f"SELECT CAST(sum(bytes) AS DOUBLE) AS x FROM {_TASKS} GROUP BY worker"))
def workers_memory_histogram(spark, d):
    return agg.histogram(_tasks(spark, d).groupBy("worker").agg(F.sum("bytes").cast("double").alias("x")), "x", 40)


@query(_HISTOGRAM.format(f"SELECT CAST(count(*) AS DOUBLE) AS x FROM {_TASKS} GROUP BY worker"))
def processing_histogram(spark, d):
    return agg.histogram(_tasks(spark, d).groupBy("worker").agg(F.count("*").cast("double").alias("x")), "x", 40)


_SENT = f"SELECT worker AS source, (worker + bytes) % {PEERS} AS target, kind, bytes, secs FROM {_TASKS}"


def _sent(spark, d):
    return _tasks(spark, d).select(F.col("worker").alias("source"), ((F.col("worker") + F.col("bytes")) % PEERS).alias("target"), "kind", "bytes", "secs")


@query(f"WITH s AS ({_SENT}), o AS (SELECT source AS worker, CAST(sum(bytes) AS BIGINT) AS outgoing FROM s GROUP BY ALL), i AS (SELECT target AS worker, CAST(sum(bytes) AS BIGINT) AS incoming FROM s GROUP BY ALL) SELECT worker, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing FROM o FULL JOIN i USING (worker)")
def workers_transfer_bytes(spark, d):
    s = _sent(spark, d)
    out, into = (s.groupBy(F.col(c).alias("worker")).agg(F.sum("bytes").alias(name)) for c, name in (("source", "outgoing"), ("target", "incoming")))
    return merge(out, into, "outer", on=["worker"]).select("worker", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("incoming", "outgoing")))


_RATE = "CASE WHEN sum(secs) > 0 THEN round(sum(bytes) / sum(secs), 6) ELSE 0 END AS bandwidth"


def _bandwidth():
    return F.when(F.sum("secs") > 0, F.round(F.sum("bytes") / F.sum("secs"), 6)).otherwise(0.0).alias("bandwidth")


@query(f"SELECT kind, {_RATE} FROM ({_SENT}) GROUP BY kind")
def bandwidth_types(spark, d):
    return _sent(spark, d).groupBy("kind").agg(_bandwidth())


@query(f"SELECT source, target, {_RATE} FROM ({_SENT}) GROUP BY ALL")
def bandwidth_workers(spark, d):
    return _sent(spark, d).groupBy("source", "target").agg(_bandwidth())


@query(f"SELECT event_id, bytes, CASE WHEN secs > 0 THEN round(bytes / secs, 6) ELSE 0 END AS bandwidth, round(start + secs / 2, 3) AS middle FROM {_TASKS}")
def communicating_stream(spark, d):
    return _tasks(spark, d).select("event_id", "bytes", F.when(F.col("secs") > 0, F.round(F.col("bytes") / F.col("secs"), 6)).otherwise(0.0).alias("bandwidth"), F.round(F.col("start") + F.col("secs") / 2, 3).alias("middle"))


@query(f"WITH w AS (SELECT worker, sum(secs) AS occupancy FROM {_TASKS} GROUP BY ALL) SELECT worker, round(occupancy, 4) AS occupancy, CASE WHEN occupancy > 2 * m THEN 'saturated' WHEN occupancy < m / 2 THEN 'idle' ELSE 'busy' END AS class FROM w, (SELECT avg(occupancy) AS m FROM w)")
def occupancy(spark, d):
    """Seconds of work of each worker, against the mean of all."""
    w = _tasks(spark, d).groupBy("worker").agg(F.sum("secs").alias("occupancy"))
    mean = w.agg(F.avg("occupancy").alias("m"))  # one row
    kind = F.when(F.col("occupancy") > 2 * F.col("m"), "saturated").when(F.col("occupancy") < F.col("m") / 2, "idle").otherwise("busy")
    return w.crossJoin(F.broadcast(mean)).select("worker", F.round("occupancy", 4).alias("occupancy"), kind.alias("class"))


@query(f"SELECT worker, count(*) AS processing, round(avg(secs), 6) AS cpu, CASE WHEN count(*) > 100 THEN 'high' WHEN count(*) > 10 THEN 'some' ELSE 'low' END AS class FROM {_TASKS} GROUP BY worker")
def current_load(spark, d):
    n = F.count("*")
    return _tasks(spark, d).groupBy("worker").agg(n.alias("processing"), F.round(F.avg("secs"), 6).alias("cpu"), F.when(n > 100, "high").when(n > 10, "some").otherwise("low").alias("class"))


@query("SELECT date_trunc('minute', ts) AS minute, round(avg(value), 6) AS cpu, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS memory FROM events GROUP BY ALL")
def system_timeseries(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(scalar.floor_to(F.col("ts"), 60).alias("minute")).agg(F.round(F.avg("value"), 6).alias("cpu"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("memory"))


@query(f"WITH k AS (SELECT kind, sum(secs) AS secs FROM {_TASKS} GROUP BY ALL), m AS (SELECT max(secs) AS most FROM k) SELECT kind, round(secs, 4) AS secs, round(secs / sum(secs) OVER (), 8) AS share FROM k, m WHERE secs >= 0.02 * most")
def compute_per_key(spark, d):
    """Seconds by kind and their share of those shown, without kinds below 2 % of the greatest."""
    k = _tasks(spark, d).groupBy("kind").agg(F.sum("secs").alias("secs"))
    most = k.agg(F.max("secs").alias("most"))  # one row
    shown = k.crossJoin(F.broadcast(most)).where("secs >= 0.02 * most").select("kind", "secs")
    return agg.share_of_total(shown, ["kind"], F.col("secs")).select("kind", F.round("total", 4).alias("secs"), F.round("share", 8).alias("share"))


@query(f"SELECT kind, round(sum(secs), 4) AS secs FROM {_TASKS} GROUP BY ALL ORDER BY sum(secs) DESC")
def aggregate_action(spark, d):
    return _tasks(spark, d).groupBy("kind").agg(F.sum("secs").alias("total")).orderBy(F.desc("total")).select("kind", F.round("total", 4).alias("secs"))


@query(f"WITH s AS (SELECT kind, CAST(bytes % 3 AS INTEGER) AS activity, sum(secs) AS secs FROM {_TASKS} GROUP BY ALL) SELECT kind, activity, round(secs / sum(secs) OVER (PARTITION BY kind) * 100, 6) AS percent, round(sum(secs) OVER (PARTITION BY kind ORDER BY activity) - secs, 4) AS below FROM s")
def fine_performance_metrics(spark, d):
    """Share of each activity in the seconds of its kind, and where its bar begins on those below it."""
    s = _tasks(spark, d).groupBy("kind", (F.col("bytes") % 3).cast("int").alias("activity")).agg(F.sum("secs").alias("secs"))
    of, upto = Window.partitionBy("kind"), Window.partitionBy("kind").orderBy("activity")
    return s.select("kind", "activity", F.round(F.col("secs") / F.sum("secs").over(of) * 100, 6).alias("percent"), F.round(F.sum("secs").over(upto) - F.col("secs"), 4).alias("below"))


@query(f"WITH t AS (SELECT worker, start - lag(start) OVER (PARTITION BY worker ORDER BY start, event_id) AS gap, secs FROM {_TASKS}) SELECT worker, round(avg(gap), 3) AS interval, round(CASE WHEN sum(gap) > 0 THEN sum(secs) / sum(gap) ELSE 0 END, 6) AS busy FROM t GROUP BY worker")
def contention(spark, d):
    gap = F.col("start") - F.lag("start").over(Window.partitionBy("worker").orderBy("start", "event_id"))
    t = _tasks(spark, d).withColumn("gap", gap)
    return t.groupBy("worker").agg(F.round(F.avg("gap"), 3).alias("interval"), F.round(F.when(F.sum("gap") > 0, F.sum("secs") / F.sum("gap")).otherwise(0.0), 6).alias("busy"))


@query(f"SELECT bytes AS key, string_agg(CAST(worker AS VARCHAR), ',' ORDER BY worker) AS workers, count(*) AS n FROM (SELECT DISTINCT bytes, worker FROM {_TASKS} WHERE kind = 'error') GROUP BY ALL")
def exceptions_table(spark, d):
    errors = _tasks(spark, d).where("kind = 'error'").select(F.col("bytes").alias("key"), "worker").distinct()
    lists = agg.collect_groups(errors, ["key"], ["worker"], "worker", "workers")
    return lists.select("key", F.array_join(F.transform("workers", lambda w: w.cast("string")), ",").alias("workers"), F.size("workers").cast("bigint").alias("n"))


@query(f"SELECT coalesce(CAST(worker AS VARCHAR), 'total') AS worker, count(*) AS tasks, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(secs), 4) AS secs FROM {_TASKS} GROUP BY ROLLUP (worker)")
def worker_table(spark, d):
    rows = _tasks(spark, d).rollup("worker").agg(F.count("*").alias("tasks"), F.sum("bytes").alias("bytes"), F.round(F.sum("secs"), 4).alias("secs"))
    return rows.withColumn("worker", F.coalesce(F.col("worker").cast("string"), F.lit("total")))


@query(f"SELECT kind AS shuffle, worker, CAST(sum(bytes) AS BIGINT) AS sent, count(*) AS parts, count(*) FILTER (WHERE secs > 100) AS on_disk FROM {_TASKS} GROUP BY ALL")
def shuffling(spark, d):
    return _tasks(spark, d).groupBy(F.col("kind").alias("shuffle"), "worker").agg(F.sum("bytes").alias("sent"), F.count("*").alias("parts"), F.count_if(F.col("secs") > 100).alias("on_disk"))


_NEXT = f"SELECT kind, lead(kind) OVER (PARTITION BY worker ORDER BY start, event_id) AS follows FROM {_TASKS}"


@query(f"SELECT kind, follows, count(*) AS n FROM ({_NEXT}) WHERE follows IS NOT NULL GROUP BY ALL")
def task_group_graph(spark, d):
    """Edges between kinds of tasks, with how often one followed the other on a worker."""
    follows = F.lead("kind").over(Window.partitionBy("worker").orderBy("start", "event_id"))
    return _tasks(spark, d).select("kind", follows.alias("follows")).where("follows IS NOT NULL").groupBy("kind", "follows").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS stored, count(*) FILTER (WHERE kind = 'error') AS erred, count(DISTINCT worker) AS connections, round(max(start) - min(start), 3) AS uptime FROM {_TASKS}")
def state_table(spark, d):
    return _tasks(spark, d).agg(F.count("*").alias("stored"), F.count_if(F.col("kind") == "error").alias("erred"), F.count_distinct("worker").alias("connections"), F.round(F.max("start") - F.min("start"), 3).alias("uptime"))


@query(f"SELECT kind, n, CAST((row_number() OVER (ORDER BY n DESC, kind) - 1) % 2 AS INTEGER) AS \"row\", CAST((row_number() OVER (ORDER BY n DESC, kind) - 1) // 2 AS INTEGER) AS \"column\" FROM (SELECT kind, count(*) AS n FROM {_TASKS} GROUP BY ALL) ORDER BY n DESC, kind LIMIT 4")
def progress_quads(spark, d):
    """The most frequent kinds on a grid of two rows and two columns."""
    top = _tasks(spark, d).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(4)
    at = F.row_number().over(Window.orderBy(F.desc("n"), "kind")) - 1  # over four rows
    return top.select("kind", "n", (at % 2).cast("int").alias("row"), F.floor(at / 2).cast("int").alias("column"))


@query(f"SELECT worker, round(sum(secs) FILTER (WHERE kind <> 'error'), 4) AS io, max(bytes) AS peak FROM {_TASKS} GROUP BY worker")
def worker_network_bandwidth(spark, d):
    return _tasks(spark, d).groupBy("worker").agg(F.round(F.sum(F.when(F.col("kind") != "error", F.col("secs"))), 4).alias("io"), F.max("bytes").alias("peak"))


@query("SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) FILTER (WHERE value < 10) AS idle, count(DISTINCT user_id) FILTER (WHERE value > 50) AS saturated FROM events GROUP BY ALL")
def stealing_time_series(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(scalar.floor_to(F.col("ts"), 3600).alias("hour")).agg(F.count_distinct(F.when(F.col("value") < 10, F.col("user_id"))).alias("idle"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("saturated"))


# What follows is about spans: a span is an event, its parent the event whose number is a quarter of its own.
_TREE = "WITH RECURSIVE e AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 4 END AS parent, event_type, value FROM events), t AS (SELECT id AS root, id AS node FROM e UNION ALL SELECT t.root, e.id FROM t JOIN e ON e.parent = t.node)"


def _spans(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("span_id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 4)).alias("parent_id"), F.array("event_type").alias("name"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("nbytes"))


@query(f"{_TREE} SELECT root, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS nbytes, bool_and(ev.event_type <> 'error') AS done FROM t JOIN events ev ON ev.event_id = t.node GROUP BY root")
def span_nbytes_done(spark, d):
    """Bytes of a span and all below it, and whether none of them failed."""
    s = _spans(spark, d)
    own = s.select("span_id", "nbytes", (F.col("event_type") == "error").cast("bigint").alias("failed"))
    df = telemetry.subtree_sums(s.select("span_id", "parent_id"), own, ["nbytes", "failed"])
    return df.select(F.col("span_id").alias("root"), "nbytes", (F.col("failed") == 0).alias("done"))


@query(f"""{_TREE}, k AS (SELECT root, e.event_type AS activity, sum(e.value) AS value FROM t JOIN e ON e.id = t.node GROUP BY ALL),
r AS (SELECT e.id AS root, 'idle or other spans' AS activity, greatest(0, e.value * 10 - coalesce((SELECT sum(value) FROM k WHERE k.root = e.id), 0)) AS value FROM e)
SELECT root AS span_id, activity, round(value, 4) AS value FROM (SELECT * FROM k UNION ALL SELECT * FROM r)""")
def cumulative_worker_metrics(spark, d):
    """Seconds by activity below each span, and what is left of ten times its own value as its active seconds."""
    s = _spans(spark, d)
    metrics = s.select("span_id", F.col("event_type").alias("activity"), "value")
    df = telemetry.subtree_metrics(s.select("span_id", "parent_id"), metrics, s.select("span_id", (F.col("value") * 10).alias("active")))
    return df.select("span_id", "activity", F.round("value", 4).alias("value"))


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 4 END AS parent, event_type, value FROM events),
p AS (SELECT a.id FROM e a LEFT JOIN e b ON a.parent = b.id WHERE a.event_type IN ('error', 'signup') AND NOT coalesce(b.event_type IN ('error', 'signup'), false)),
t AS (SELECT id FROM p UNION SELECT e.id FROM t JOIN e ON e.parent = t.id) SELECT count(*) AS spans, round(sum(value), 4) AS value FROM e WHERE id IN (SELECT id FROM t)""")
def spans_merged_by_tags(spark, d):
    return telemetry.merge_by_tags(_spans(spark, d), ["error", "signup"], ["value"]).select("spans", F.round("value", 4).alias("value"))


_PATH = "(SELECT [event_type, 'w' || CAST(user_id % 5 AS VARCHAR), 'k' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR)] AS path, user_id, ts FROM events)"


def _samples(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    path = F.array("event_type", F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")), F.concat(F.lit("k"), (k % 3).cast("string")))
    return table(spark, d, "events").select(path.alias("path"), F.lit(1).alias("count"), "user_id", "ts")


_MERGED = f"SELECT array_to_string(path[1:n], '/') AS call, count(*) AS n FROM {_PATH}, (SELECT unnest([1, 2, 3]) AS n) GROUP BY ALL"


@query(_MERGED.replace("AS n FROM", "AS count FROM", 1))
def profile_merge(spark, d):
    return telemetry.merge_profiles(_samples(spark, d)).select(F.array_join("path", "/").alias("call"), "count")


@query(_MERGED.replace("AS n FROM", "AS count FROM", 1).replace("GROUP BY ALL", "WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts < (SELECT min(ts) FROM events) + INTERVAL 3 DAY AND user_id % 5 = 2 GROUP BY ALL"))
def profile_range(spark, d):
    """The merged profile of two days and one group of workers."""
    s = _samples(spark, d)
    first = s.agg(F.min("ts")).first()[0]
    if first is None:
        return telemetry.profile_of(s, "ts").select(F.array_join("path", "/").alias("call"), "count")
    some = telemetry.profile_of(s.withColumn("group", F.col("user_id") % 5), "ts", F.lit(first + timedelta(days=1)), F.lit(first + timedelta(days=3)), group=2)
    return some.select(F.array_join("path", "/").alias("call"), "count")


@query(f"""WITH m AS (SELECT path[1:n] AS path, count(*) AS c FROM {_PATH}, (SELECT unnest([1, 2, 3]) AS n) GROUP BY ALL)
SELECT array_to_string(path, '/') AS call, CAST(sum(c) OVER w - c AS BIGINT) AS "left", CAST(sum(c) OVER w AS BIGINT) AS "right" FROM m WINDOW w AS (PARTITION BY path[1:len(path) - 1] ORDER BY c DESC, path ROWS UNBOUNDED PRECEDING)""")
def profile_icicle(spark, d):
    df = telemetry.icicle(telemetry.merge_profiles(_samples(spark, d)))
    return df.select(F.array_join("path", "/").alias("call"), "left", "right")


@query("SELECT date_trunc('second', ts) AS second, event_type, count(*) AS n FROM events GROUP BY ALL")
def profile_metadata(spark, d):
    """Samples by second and kind."""
    return table(spark, d, "events").groupBy(scalar.floor_to(F.col("ts"), 1).alias("second"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def task_stream_collect(spark, d):
    zone = lambda day: F.lit(day).cast("timestamp_ntz")
    return telemetry.time_slice(table(spark, d, "events"), "ts", zone("2024-01-02"), zone("2024-01-05")).select("event_id", "value")


@query("SELECT event_id, lane, CAST(lane % 3 AS INTEGER) AS col, CAST(lane // 3 AS INTEGER) AS line FROM (SELECT event_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS lane FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS f FROM events))")
def grid_placement(spark, d):
    """Workers by first appearance on a grid of three columns."""
    df = windows.dense_by_first(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", "lane")
    return df.select("event_id", "lane", (F.col("lane") % 3).cast("int").alias("col"), F.floor(F.col("lane") / 3).cast("int").alias("line"))


@query("SELECT event_id, list_concat([event_type], [CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)])[2] AS second, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_lists(spark, d):
    """Lists of lists as one, and what lies at a path in them."""
    e = table(spark, d, "events")
    flat = scalar.flatten_lists(F.array(F.array("event_type"), F.array(F.col("user_id").cast("string"), F.col("event_id").cast("string"))))
    made = F.struct(F.struct(F.lit(0).cast("bigint").alias("k")).alias("props"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", scalar.path_get(flat, 1).alias("second"), scalar.path_get(scalar.path_set(made, k, "props", "k"), "props", "k").alias("k"))


@query("SELECT count(DISTINCT event_type || '/' || CAST(user_id AS VARCHAR)) AS tokens FROM events")
def key_tokens(spark, d):
    """Equal parts have equal tokens, others don't."""
    return table(spark, d, "events").agg(F.count_distinct(scalar.key_token(F.col("event_type"), F.col("user_id"))).alias("tokens"))

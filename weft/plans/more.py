"""User functions, blocks, resampling, stories and feeds."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from weft.functions import scalar, user
from weft.operators import arrays, joins, windows
from weft.operators import aggregates as agg
from weft.plans.registry import query
from weft.plans.reports import _TASKS, _tasks
from weft.sources import number_range, shared_folder, table
from weft.streaming import feeds


@query("SELECT o_orderkey AS idx FROM orders")
def index_projection(spark, d):
    """The index is a column like others."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))


@query("SELECT page_id, substr(url, 1, 20) AS url FROM pages")
def truncate_text(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.truncate(F.col("url"), 20).alias("url"))


@query("SELECT value % 13 AS k, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (SELECT unnest(range(0, 1000, 3)) AS value) GROUP BY ALL")
def bag_range(spark, d):
    return number_range(spark, 0, 1000, 3, 4).groupBy((F.col("value") % 13).alias("k")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT event_id, round(sqrt(value) + ln(1 + value), 9) AS y FROM events")
def udf_vector(spark, d):
    """Whole columns at once."""
    curve = user.vector(_curve, "double")
    return table(spark, d, "events").select("event_id", F.round(curve("value"), 9).alias("y"))


def _curve(x: pd.Series) -> pd.Series:
    return np.sqrt(x) + np.log1p(x)


@query("SELECT event_id, unnest(range(0, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS BIGINT))) AS step FROM events")
def udf_rows(spark, d):
    e = table(spark, d, "events").select("event_id", (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("n"))
    return user.rows_from(e, _steps, "event_id bigint, step bigint")


def _steps(row):
    return ({"event_id": row.event_id, "step": k} for k in range(int(row.n)))


@query("SELECT user_id, count(*) * 2 AS twice FROM events GROUP BY ALL")
def udf_coroutine(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return user.concurrently(counts, "n", _twice, "twice", "bigint").select("user_id", "twice")


async def _twice(n):
    return int(n) * 2


@query("SELECT user_id, event_type, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events GROUP BY ALL")
def group_apply_two_keys(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    return user.by_groups(e, ["user_id", "event_type"], _spreads, "user_id bigint, event_type string, n bigint, spread double").withColumn("spread", F.round("spread", 6))


def _spreads(part: pa.Table) -> pa.Table:
    """As SQL has it, a group with a NaN has a spread of NaN."""
    part = part.append_column("nan", pc.is_nan(part["value"]))
    g = part.group_by(["user_id", "event_type"], use_threads=False).aggregate([([], "count_all"), ("value", "max"), ("value", "min"), ("nan", "any")])
    spread = pc.if_else(pc.fill_null(g["nan_any"], False), pa.scalar(float("nan")), pc.subtract(g["value_max"], g["value_min"]))
    return pa.table({"user_id": g["user_id"], "event_type": g["event_type"], "n": g["count_all"], "spread": spread})


@query("SELECT CAST(vec_id // 100 AS INTEGER) AS bi, count(*) AS n, round(sum(CAST(embedding[j] AS DOUBLE) * CAST(embedding[j] AS DOUBLE) + 2 * CAST(embedding[j] AS DOUBLE)), 6) AS total FROM embeddings, range(1, 65) t(j) GROUP BY ALL")
def array_blockwise(spark, d):
    """A function of blocks that lie at the same place in two arrays: x * y + 2 * x, both being the embeddings."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]
    x = arrays.to_blocks(arrays.cells(e, "vec_id", "embedding"), arrays.even_chunks(n, 100), [64])
    out = arrays.blockwise([x, x], _product)
    return out.select("bi", F.size("data").cast("bigint").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def _product(x, y):
    return x * y + 2 * x


@query(f"SELECT worker FROM (SELECT worker, sum(bytes) OVER (ORDER BY bytes, worker ROWS UNBOUNDED PRECEDING) AS upto, sum(bytes) OVER () AS every FROM (SELECT worker, sum(bytes) AS bytes FROM {_TASKS} GROUP BY ALL)) WHERE upto * 2 <= every")
def workers_to_close(spark, d):
    """Those with the least bytes, as long as they hold no more than half of all."""
    w = _tasks(spark, d).groupBy("worker").agg(F.sum("bytes").alias("bytes"))
    every = w.agg(F.sum("bytes").alias("every"))  # one row
    return windows.cumulative_sum(w, "bytes", ["bytes", "worker"], into="upto").crossJoin(F.broadcast(every)).where("upto * 2 <= every").select("worker")


@query("""WITH g AS (SELECT user_id, unnest(range(CAST(floor(min(epoch(ts)) / 86400) AS BIGINT) * 86400, CAST(max(epoch(ts)) AS BIGINT) + 1, 86400)) * 1000000 AS t FROM events GROUP BY user_id),
s AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS v FROM events GROUP BY ALL),
b AS (SELECT g.*, s.t AS bt, s.v AS bv FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.t >= s.t),
c AS (SELECT b.*, s.t AS ct, s.v AS cv FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.t <= s.t)
SELECT user_id, t, CASE WHEN ct IS NULL OR t - bt <= ct - t THEN bv ELSE cv END AS value FROM c""")
def resample_nearest(spark, d):
    """Each user's series on a grid of days: the sample that is nearest."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    first, last = (F.floor(F.min("t") / 86_400_000_000) * 86_400).cast("bigint"), F.bround(F.max("t") / 1_000_000).cast("bigint")
    grid = e.groupBy("user_id").agg(F.sequence(first, last, F.lit(86_400).cast("bigint")).alias("g")).select("user_id", F.explode(F.transform("g", lambda s: s * 1_000_000)).alias("t"))
    samples = e.groupBy("user_id", "t").agg(F.max("value").alias("v"))
    return joins.nearest(grid, samples, "t", ["user_id"], "v", "value").select("user_id", "t", "value")


@query(f"SELECT worker, count(*) AS n FROM (SELECT worker, unnest(list(kind)) AS kind FROM {_TASKS} GROUP BY worker) WHERE kind = 'error' GROUP BY worker")
def worker_tasks_in_state(spark, d):
    """From a row for each worker with all its tasks."""
    dump = _tasks(spark, d).groupBy("worker").agg(F.collect_list("kind").alias("tasks"))
    return dump.select("worker", F.explode("tasks").alias("kind")).where("kind = 'error'").groupBy("worker").agg(F.count("*").alias("n"))


@query("SELECT user_id AS key, string_agg(event_type, ',' ORDER BY event_id) AS story FROM events WHERE user_id IN (3, 7, 11) GROUP BY ALL")
def story_by_key(spark, d):
    log = table(spark, d, "events").where(F.col("user_id").isin(3, 7, 11)).withColumnRenamed("user_id", "key")
    return agg.collect_groups(log, ["key"], ["event_id"], "event_type", "story").select("key", F.array_join("story", ",").alias("story"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS slow FROM events GROUP BY ALL")
def streaming_progress(spark, d):
    """Counts by kind at each tick; the last tick's are those of all."""
    schema = table(spark, d, "events").schema
    stream = feeds.follow(spark, d, schema, glob="events.parquet")
    counts = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("slow"))
    return feeds.drain(counts, f"{shared_folder(spark)}/{uuid.uuid4().hex}", "complete")

"""Exchange, intervals, step functions, telemetry and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import scalar, user
from weft.operators import aggregates as agg
from weft.operators import arrays, intervals, telemetry, windows
from weft.operators import exchange as ex
from weft.plans.registry import query
from weft.plans.relational import _SPAN, seconds, spans
from weft.sources import table

_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT event_id, user_id FROM events WHERE user_id % 8 IN (0, 3, 5)")
def exchange_partition_subset(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id").withColumn("p", (F.col("user_id") % 8).cast("int"))
    return ex.exchange(df, "p", 8, [0, 3, 5])


@query("SELECT event_id, p, row_number() OVER (PARTITION BY p ORDER BY event_id) AS pos FROM (SELECT event_id, CAST(user_id % 8 AS INTEGER) AS p FROM events)")
def exchange_stable_order(spark, d):
    df = table(spark, d, "events").select("event_id", (F.col("user_id") % 8).cast("int").alias("p"))
    moved = ex.exchange(df, "p", 8, drop=False, order=["event_id"])
    # positions follow the order in which rows lie in their partition
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return moved.select("event_id", "p", at.alias("pos"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 10000 THEN 2 WHEN o_orderkey >= 3000 THEN 1 ELSE 0 END AS part FROM orders")
def set_index_divisions(spark, d):
    """The last division has nearly all rows, so divisions lie in many partitions. A null falls in the first, as in SQL."""
    df = ex.set_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", (0, 3000, 10000, 1 << 60), into="part")
    return df.withColumn("part", F.coalesce("part", F.lit(0)))


_SWEEP = f"""s AS ({_SPAN}),
e AS (SELECT user_id, t, sum(d) AS d FROM (SELECT user_id, start AS t, 1 AS d FROM s WHERE start < stop UNION ALL SELECT user_id, stop, -1 FROM s WHERE start < stop) GROUP BY ALL),
n AS (SELECT user_id, t, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS n, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1 FROM e),
m AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY t), 0) AS p FROM n),
r AS (SELECT *, sum(CASE WHEN p = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM m),
u AS (SELECT user_id, run, min(t) AS start, max(t1) AS stop, CAST(max(n) AS BIGINT) AS most FROM r WHERE n > 0 GROUP BY ALL)"""


@query(f"WITH {_SWEEP} SELECT user_id, CAST(round(start * 1000000) AS BIGINT) AS start, CAST(round(stop * 1000000) AS BIGINT) AS stop, most FROM u")
def interval_union(spark, d):
    df = intervals.active(spans(spark, d), "start", "stop", ["user_id"])
    return df.select("user_id", *(F.round(F.col(c) * 1_000_000).cast("bigint").alias(c) for c in ("start", "stop")), "most")


@query(f"WITH {_SWEEP} SELECT user_id, round(sum(stop - start), 2) AS busy, count(*) AS runs FROM u GROUP BY ALL")
def active_seconds(spark, d):
    return intervals.active(spans(spark, d), "start", "stop", ["user_id"]).groupBy("user_id").agg(F.round(F.sum(F.col("stop") - F.col("start")), 2).alias("busy"), F.count("*").alias("runs"))


@query("SELECT user_id, round(coalesce(sum(value * dt), 0), 1) AS integral FROM (SELECT user_id, value, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS dt FROM (SELECT user_id, epoch(ts) AS t, max(value) AS value FROM events GROUP BY ALL)) GROUP BY ALL")
def step_integral(spark, d):
    e = table(spark, d, "events").groupBy("user_id", seconds().alias("t")).agg(F.max("value").alias("value"))
    return intervals.step_integral(e, "t", "value", ["user_id"]).select("user_id", F.round("integral", 1).alias("integral"))


@query(f"""WITH s AS ({_SPAN}), c AS (SELECT *, unnest(range(CAST(floor(start / 60) AS BIGINT), CAST(ceil(stop / 60) AS BIGINT))) AS bin FROM s WHERE start < stop)
SELECT event_type, bin, round(sum(least(stop, (bin + 1) * 60) - greatest(start, bin * 60)), 3) AS busy FROM c GROUP BY ALL""")
def bin_allocation(spark, d):
    df = intervals.allocate(spans(spark, d), "start", "stop", 60.0, ["event_type"])
    return df.select("event_type", "bin", F.round("busy", 3).alias("busy"))


@query(f"SELECT user_id, event_type, round(min(start), 3) AS start, round(max(stop), 3) AS stop, CAST(sum(greatest(floor((stop - start) * 1000), 0)) AS BIGINT) AS millis FROM ({_SPAN}) GROUP BY ALL")
def span_durations(spark, d):
    s = spans(spark, d).withColumn("ms", F.greatest(F.floor((F.col("stop") - F.col("start")) * 1000), F.lit(0)))
    return s.groupBy("user_id", "event_type").agg(F.round(F.min("start"), 3).alias("start"), F.round(F.max("stop"), 3).alias("stop"), F.sum("ms").alias("millis"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY ALL")
def span_states(spark, d):
    return telemetry.states(table(spark, d, "events"), ["user_id"], "event_type", _TYPES)


@query("SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES) + ", round(sum(value), 3) AS total FROM events")
def counts_summary(spark, d):
    return telemetry.summary(table(spark, d, "events"), "event_type", _TYPES, "value").withColumn("total", F.round("total", 3))




@query("WITH m AS (SELECT max(epoch(ts)) AS m FROM events) SELECT event_type, " + ", ".join(f"round(sum(exp(-(m - epoch(ts)) / {s})), 6) AS last_{s}" for s in (3600, 86400)) + " FROM events, m GROUP BY ALL")
def decayed_counts(spark, d):
    e = table(spark, d, "events").withColumn("t", seconds())
    now = e.agg(F.max("t").alias("now"))  # one row
    df = agg.decayed_counts(e.crossJoin(F.broadcast(now)), "event_type", "t", F.col("now"), (3600, 86400))
    return df.select("event_type", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


@query("""WITH o AS (SELECT user_id, value, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) - row_number() OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(sum(value * pow(0.5, later) * CASE WHEN r = 1 THEN 1 ELSE 0.5 END), 6) AS ewma FROM o GROUP BY ALL""")
def ewma(spark, d):
    return agg.ewma(table(spark, d, "events"), ["user_id"], ["event_id"], "value").withColumn("ewma", F.round("ewma", 6))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN value END AS v FROM events)
SELECT event_id, user_id, CASE WHEN first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) IS NOT NULL THEN last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS filled FROM e""")
def ffill_bounded(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", F.col("value")).alias("v"))
    return windows.fill_forward(e, "v", ["event_id"], ["user_id"], "filled").select("event_id", "user_id", "filled")


@query("""WITH g AS (SELECT date_trunc('minute', ts) AS ts, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'error') AS error FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL)
SELECT ts, """ + ", ".join(f"CASE WHEN first_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) IS NOT NULL THEN last_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS {c}" for c in ("click", "error")) + " FROM g")
def align_series(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "error")).withColumn("ts", scalar.floor_to(F.col("ts"), 60))
    return intervals.align(e, "event_type", "ts", "value", ["click", "error"])


@query("SELECT user_id, event_type, epoch_us(min(ts)) - (SELECT epoch_us(min(ts)) FROM events) AS since FROM events GROUP BY ALL")
def rebase_first(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    zero = e.agg(F.min("us").alias("zero"))  # one row
    return e.groupBy("user_id", "event_type").agg(F.min("us").alias("m")).crossJoin(F.broadcast(zero)).select("user_id", "event_type", (F.col("m") - F.col("zero")).alias("since"))


_CELLS = "(SELECT vec_id AS i, CAST(j - 1 AS BIGINT) AS j, CAST(embedding[j] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(j))"


def _cells(spark, d):
    return arrays.cells(table(spark, d, "embeddings"), "vec_id", "embedding")


def _rows(spark, d) -> int:
    return table(spark, d, "embeddings").agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]


@query(f"SELECT a.i, a.j, round(a.v + b.v, 9) AS v FROM {_CELLS} a JOIN {_CELLS} b ON a.i = b.i AND a.j = 63 - b.j")
def array_transpose_add(spark, d):
    """x.T + y, x being the transpose of the array with its columns in reverse."""
    y = _cells(spark, d)
    x = arrays.transpose(y.withColumn("j", 63 - F.col("j")))
    return arrays.add(arrays.transpose(x), y).withColumn("v", F.round("v", 9))


@query(f"WITH c AS (SELECT * FROM {_CELLS}) SELECT p.j AS k, round(stddev_pop(p.v), 6) AS std FROM (SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY ALL) p GROUP BY ALL")
def array_dot_std(spark, d):
    """Of the product of the transposed array with the array: partial products of batches of rows."""
    return arrays.along(arrays.gram(table(spark, d, "embeddings"), "embedding"), 0).select("k", F.round("std", 6).alias("std"))


@query(f"WITH c AS (SELECT * FROM {_CELLS}) SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) AS v FROM c a JOIN c b ON a.i = b.i WHERE a.j < 4 AND b.j < 4 GROUP BY ALL")
def array_dot(spark, d):
    """The same product cell by cell, of the first four columns: a join on the inner index."""
    a = _cells(spark, d).where("j < 4")
    return arrays.dot(arrays.transpose(a), a).withColumn("v", F.round("v", 6))


@query("SELECT i, CAST(j - 1 AS BIGINT) AS j, round(v - avg(v) OVER (PARTITION BY i), 9) AS v FROM (SELECT vec_id AS i, j, CAST(embedding[j] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(j))")
def array_demean(spark, d):
    return arrays.without_mean(arrays.cells(table(spark, d, "embeddings"), "vec_id", "embedding"), 1).withColumn("v", F.round("v", 9))


@query(f"SELECT CAST(i // 320 AS INTEGER) AS bi, CAST(j // 16 AS INTEGER) AS bj, count(*) AS n, round(sum(v), 6) AS total FROM {_CELLS} GROUP BY ALL")
def array_rechunk(spark, d):
    n = _rows(spark, d)
    old, new = (arrays.even_chunks(n, 100), [40, 24]), (arrays.even_chunks(n, 320), [16] * 4)
    blocks = arrays.rechunk(arrays.to_blocks(_cells(spark, d), *old), old, new)
    return blocks.select("bi", "bj", F.size("data").cast("bigint").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH c AS (SELECT vec_id AS i, j - 1 AS p, CAST(embedding[j] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(j))
SELECT CAST(i // 250 AS INTEGER) AS b0, CAST(p // 16 // 2 AS INTEGER) AS b1, CAST(p // 4 % 4 // 4 AS INTEGER) AS b2, CAST(p % 4 // 1 AS INTEGER) AS b3, count(*) AS n, round(sum(v), 6) AS total FROM c GROUP BY ALL""")
def array_rechunk_nd(spark, d):
    """Vectors of 64 as 4 x 4 x 4, so an array of four axes: from blocks of 100 whole vectors to others on all axes."""
    n = _rows(spark, d)
    old, new = (arrays.even_chunks(n, 100), [4], [4], [4]), (arrays.even_chunks(n, 250), [2, 2], [4], [1] * 4)
    wide = arrays.to_blocks(_cells(spark, d), old[0], [64])
    blocks = wide.select(F.array("bi", F.lit(0), F.lit(0), F.lit(0)).alias("index"), F.array(F.col("shape")[0], *[F.lit(4)] * 3).alias("shape"), "data")
    made = arrays.rechunk_nd(blocks, old, new)
    return made.select(*(F.col("index")[k].alias(f"b{k}") for k in range(4)), F.size("data").cast("bigint").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"SELECT CAST(i // 320 AS INTEGER) AS bi, CAST(j // 16 AS INTEGER) AS bj, round(sum(v), 6) AS total FROM {_CELLS} WHERE j >= 48 GROUP BY ALL")
def array_rechunk_cull(spark, d):
    """Only the last column of blocks is asked for, so only its parts are sent."""
    n = _rows(spark, d)
    old, new = (arrays.even_chunks(n, 100), [40, 24]), (arrays.even_chunks(n, 320), [16] * 4)
    blocks = arrays.to_blocks(_cells(spark, d), *old).select(F.array("bi", "bj").alias("index"), "shape", "data")
    made = arrays.rechunk_nd(blocks, old, new, keep=lambda index: index[1] == 3)
    return made.select(F.col("index")[0].alias("bi"), F.col("index")[1].alias("bj"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT j - 1 AS j, round(sum(CAST(embedding[j] AS DOUBLE)), 6) AS total FROM embeddings, range(1, 11) t(j) GROUP BY ALL")
def array_sparse_sum(spark, d):
    a = arrays.cells(table(spark, d, "embeddings"), "vec_id", "embedding").where("j < 10")
    return arrays.along(a, 0).select(F.col("k").alias("j"), F.round("sum", 6).alias("total"))


@query("SELECT item AS key, CAST(sum(n) AS BIGINT) AS value FROM (SELECT event_type AS item, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events) GROUP BY ALL")
def mapping_sum(spark, d):
    e = table(spark, d, "events").select(F.create_map("event_type", F.get_json_object("props", "$.k").cast("bigint")).alias("m"))
    return agg.sum_mappings(e, "m")


@query("SELECT p_partkey, CASE WHEN length(p_name) > 15 THEN substr(p_name, 1, 12) || '...' ELSE p_name END AS short FROM part")
def text_shorten(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.shorten(F.col("p_name")).alias("short"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY ALL")
def udf_group_apply(spark, d):
    return user.by_group(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], _group_size, "user_id bigint, n bigint")


def _group_size(part):
    return part.groupby("user_id", as_index=False).agg(n=("event_id", "size"))


@query("SELECT event_id, value * 2 + 1 AS y FROM events")
def udf_scalar(spark, d):
    double = user.scalar(lambda x: x * 2 + 1, "double")
    return table(spark, d, "events").select("event_id", double("value").alias("y"))


@query("SELECT event_id, round(value, 2) AS value FROM events WHERE value > 100")
def udf_map_partitions(spark, d):
    return user.by_partition(table(spark, d, "events").select("event_id", "value"), lambda f: f[f["value"] > 100].assign(value=lambda x: x["value"]), "event_id bigint, value double").withColumn("value", F.round("value", 2))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY ALL")
def approx_distinct(spark, d):
    """The sketch's count beside the exact one: it has to be within four deviations of 2 %, or of one user.

    Both come from the distinct pairs, which give the same sketch as all rows: beside a distinct count, Spark would keep a
    sketch for each pair.
    """
    pairs = table(spark, d, "events").select("event_type", "user_id").distinct()
    df = pairs.groupBy("event_type").agg(F.count("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("guess"))
    return df.select("event_type", "users", (F.abs(F.col("guess") - F.col("users")) <= F.greatest(F.lit(1.0), 0.08 * F.col("users"))).alias("near"))


@query("SELECT event_type, count(value) AS n, q, true AS near FROM events, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS q) GROUP BY ALL")
def quantiles(spark, d):
    """Quantiles of a mergeable digest; the ranks that they have in the rows have to be within its bound."""
    qs, accuracy = (0.05, 0.25, 0.5, 0.75, 0.95), 10_000
    e = table(spark, d, "events").select("event_type", "value").where("value IS NOT NULL")
    digest = e.groupBy("event_type").agg(F.count("*").alias("n"), F.percentile_approx("value", list(qs), accuracy).alias("at"))
    at = lambda k: F.col("at")[k]
    ranks = e.join(digest, "event_type").groupBy("event_type", "n").agg(*(F.count_if(F.col("value") < at(k)).alias(f"below{k}") for k in range(5)), *(F.count_if(F.col("value") <= at(k)).alias(f"upto{k}") for k in range(5)))
    bound = F.col("n") / accuracy + 1
    near = [F.struct(F.lit(q).cast("decimal(3,2)").alias("q"), ((F.col(f"below{k}") <= q * F.col("n") + bound) & (F.col(f"upto{k}") >= q * F.col("n") - bound)).alias("near")) for k, q in enumerate(qs)]
    return ranks.select("event_type", "n", F.explode(F.array(*near)).alias("x")).select("event_type", "n", "x.q", "x.near")


@query("SELECT page_id, url_encode(url) AS url FROM pages")
def url_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.url_encode("url").alias("url"))


@query("SELECT event_type, CAST(to_json({'n': count(*), 'users': count(DISTINCT user_id)}) AS VARCHAR) AS js FROM events GROUP BY ALL")
def json_counts(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return counts.select("event_type", F.to_json(F.struct("n", "users")).alias("js"))


@query("""WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT event_id, user_id, p, n, unnest(range(-2, 3)) AS k FROM o), m AS (SELECT event_id, user_id, k, CASE WHEN p + k < 0 THEN -(p + k) - 1 WHEN p + k >= n THEN 2 * n - 1 - (p + k) ELSE p + k END AS q FROM k)
SELECT m.event_id, string_agg(CAST(o.event_id AS VARCHAR), ',' ORDER BY k) AS around FROM m JOIN o ON m.user_id = o.user_id AND m.q = o.p GROUP BY m.event_id""")
def map_overlap(spark, d):
    df = windows.overlapping(table(spark, d, "events").select("event_id", "user_id"), "event_id", ["event_id"], ["user_id"], 2, "w")
    return df.select("event_id", F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("around"))


@query(f"SELECT i, j, round(v, 9) AS v FROM {_CELLS} UNION ALL SELECT i + (SELECT max(vec_id) + 1 FROM embeddings), j, round(v, 9) FROM {_CELLS}")
def array_concatenate(spark, d):
    a, n = _cells(spark, d), _rows(spark, d)
    return arrays.concatenate([(a, n), (a, n)]).withColumn("v", F.round("v", 9))


@query("SELECT user_id % 2 AS odd, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS members FROM (SELECT DISTINCT user_id FROM events) GROUP BY ALL")
def bag_groupby(spark, d):
    users = table(spark, d, "events").select("user_id", (F.col("user_id") % 2).alias("odd")).distinct()
    df = agg.collect_groups(users, ["odd"], ["user_id"], "user_id", "members")
    return df.select("odd", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"""WITH s AS ({_SPAN}) SELECT event_id, round((start + stop) / 2, 3) AS mid, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS lane FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f FROM s)""")
def task_rectangles(spark, d):
    df = telemetry.rectangles(spans(spark, d), "user_id", "start", "stop", "event_id")
    return df.select("event_id", F.round("mid", 3).alias("mid"), "lane")


@query("SELECT event_id, CASE WHEN value > 0 THEN CAST(least(greatest(round_even(log2(value) + 6, 0), 0), 14) AS INTEGER) ELSE 0 END AS level FROM events")
def log2_levels(spark, d):
    return table(spark, d, "events").select("event_id", scalar.log2_level(F.col("value")).alias("level"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' OR user_id = 7 ORDER BY event_id")
def story(spark, d):
    log = table(spark, d, "events").withColumn("user", F.concat(F.lit("user-"), "user_id"))
    return telemetry.story(log, ["error", "user-7"], "event_type", "user", "event_id").select("event_id", "event_type", "user_id")


@query("WITH RECURSIVE e AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 4 END AS parent FROM events), t AS (SELECT id AS root, id AS node FROM e UNION ALL SELECT t.root, e.id FROM t JOIN e ON e.parent = t.node) SELECT root, count(*) AS n FROM t GROUP BY root")
def span_tree(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("span_id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 4)).alias("parent_id"))
    own = e.select("span_id").distinct().withColumn("n", F.lit(1).cast("bigint"))
    nameless = e.where("span_id IS NULL").groupBy("span_id").agg(F.count("*").alias("n"))
    return telemetry.subtree_sums(e, own, ["n"]).unionByName(nameless).withColumnRenamed("span_id", "root")

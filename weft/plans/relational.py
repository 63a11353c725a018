"""Projections, filters, joins, aggregations, windows, sorting and sets."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from weft.functions.scalar import day_name, floor_to, in_zone, words
from weft.operators import aggregates as agg
from weft.operators import frames, joins, windows
from weft.plans.registry import query
from weft.sources import table


def seconds(c: str = "ts"):
    """Seconds since 1970, as a double, of a time in UTC without zone."""
    return (F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("double")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10")
def wordcount_topk(spark, d):
    w = table(spark, d, "documents").select(F.explode(words(F.col("text"))).alias("word")).where("word <> ''")
    return frames.top_k(w.groupBy("word").agg(F.count("*").alias("n")), 10, F.desc("n"), "word")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(words(F.col("text"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def project_assign(spark, d):
    df = frames.assign(table(spark, d, "lineitem"), net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))
    return df.select("l_orderkey", "l_linenumber", "net")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_gt(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (1, 2, 3, 5, 8, 13)")
def filter_isin(spark, d):
    return frames.isin(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", [1, 2, 3, 5, 8, 13])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 10 AND 100")
def filter_between(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_orderkey").between(10, 100)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-17' AND o_orderdate < TIMESTAMP '1995-01-25'")
def date_slice(spark, d):
    return frames.date_slice(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1995-01-17", "1995-01-24")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def astype(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").cast("string").alias("line"))


@query("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def categorize(spark, d):
    return frames.categorize(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code")


@query("SELECT event_id, dayname(ts) AS day FROM events")
def day_names(spark, d):
    return table(spark, d, "events").select("event_id", day_name(F.col("ts")).alias("day"))


@query("SELECT event_id, timezone('America/Chicago', timezone('UTC', ts)) AS local FROM events")
def tz_convert(spark, d):
    return table(spark, d, "events").select("event_id", in_zone(F.col("ts"), "America/Chicago").alias("local"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def date_floor(spark, d):
    return table(spark, d, "events").groupBy(floor_to(F.col("ts"), 3600).alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _sides(spark, d):
    """All orders, some without a customer, and all customers, a third under a key that no order has."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    return o, table(spark, d, "customer").select(_elsewhere(3).alias("c_custkey"), "c_name")


def _elsewhere(every: int):
    """Keys of customers, one in so many turned into one that no order has."""
    return F.when(F.col("c_custkey") % every == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))


def _plain(df, keys=("o_orderkey", "o_custkey", "c_custkey")):
    """Null keys as -1: some readers of the results take a column with nulls for floating point."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in keys})


def _join(how: str) -> str:
    return f"SELECT coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_custkey, -1) AS o_custkey, coalesce(c_custkey, -1) AS c_custkey, c_name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey FROM orders) {how} JOIN (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, c_name FROM customer) ON o_custkey = c_custkey"


@query(_join("INNER"))
def join_inner(spark, d):
    o, c = _sides(spark, d)
    return _plain(joins.merge(o, c, "inner", left_on=["o_custkey"], right_on=["c_custkey"]))


@query(_join("LEFT"))
def join_left(spark, d):
    o, c = _sides(spark, d)
    return _plain(joins.merge(o, c, "left", left_on=["o_custkey"], right_on=["c_custkey"]))


@query(_join("RIGHT"))
def join_right(spark, d):
    o, c = _sides(spark, d)
    return _plain(joins.merge(o, c, "right", left_on=["o_custkey"], right_on=["c_custkey"]))


@query(_join("FULL"))
def join_outer(spark, d):
    o, c = _sides(spark, d)
    return _plain(joins.merge(o, c, "outer", left_on=["o_custkey"], right_on=["c_custkey"]))


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_quantity AS q FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40) b USING (l_orderkey, l_linenumber)")
def join_multi_key(spark, d):
    li = table(spark, d, "lineitem")
    b = li.where("l_quantity > 40").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    return joins.merge(li.select("l_orderkey", "l_linenumber", "l_partkey"), b, on=["l_orderkey", "l_linenumber"])


@query("SELECT a.l_orderkey, a.l_quantity AS l_quantity_left, b.l_quantity AS l_quantity_right FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey)")
def join_suffixes(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber")
    return joins.merge(li.where("l_linenumber = 1").drop("l_linenumber"), li.where("l_linenumber = 2").drop("l_linenumber"), on=["l_orderkey"], suffixes=("_left", "_right"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS k FROM customer) b ON a.k = b.k")
def join_indicator(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, d, "customer").select(_elsewhere(5).alias("k"))
    return joins.merge(a, b, "outer", on=["k"], indicator="_merge")


@query("SELECT n_nationkey, n_name, r_name FROM (SELECT n_nationkey, n_name, n_regionkey AS key FROM nation) NATURAL JOIN (SELECT r_regionkey AS key, r_name FROM region)")
def join_natural(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("key"))
    return joins.merge(n, table(spark, d, "region").select(F.col("r_regionkey").alias("key"), "r_name")).drop("key")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi(table(spark, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_anti(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti(table(spark, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark, d):
    # Spark broadcasts the nations by their size
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


_NULLABLE = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)"


@query(f"SELECT a.o_orderkey, coalesce(a.k, -1) AS k, b.n, b.last FROM {_NULLABLE} a JOIN (SELECT k, count(*) AS n, max(o_orderkey) AS last FROM {_NULLABLE} GROUP BY k) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark, d):
    """Every order with the count and the last of its customer's; orders without a customer are one group."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"))
    groups = o.groupBy("k").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return _plain(joins.merge(o, groups, on=["k"], null_equal=True), ["k"])


@query("SELECT c_custkey AS id, n_orders, c_name FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY ALL) JOIN customer ON o_custkey = c_custkey")
def join_index_index(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return joins.join_on_index(o, table(spark, d, "customer").select("c_custkey", "c_name"), ["o_custkey"], ["c_custkey"], "id")


@query("SELECT o_custkey AS id, o_orderkey, coalesce(c_name, '') AS c_name FROM orders LEFT JOIN (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k, c_name FROM customer) ON o_custkey = k")
def join_column_index(spark, d):
    c = table(spark, d, "customer").select(_elsewhere(3).alias("k"), "c_name")
    df = joins.join_on_index(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], ["k"], "id", "left")
    return df.withColumn("c_name", F.coalesce("c_name", F.lit("")))


@query("SELECT a.l_orderkey AS id_0, a.l_linenumber AS id_1, a.l_quantity AS l_quantity_x, b.l_quantity AS l_quantity_y FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber + 1 AS n, l_quantity FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.n")
def join_index_and_columns(spark, d):
    """Keys that mix index levels and columns: each line with the one before it."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    before = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), "l_quantity")
    return joins.join_on_index(li, before, ["l_orderkey", "l_linenumber"], ["l_orderkey", "n"], "id")


@query("SELECT c_custkey AS id, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY ALL) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY ALL) b ON b.o_custkey = c_custkey")
def frame_join(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    counts = o.groupBy("id").agg(F.count("*").alias("n_orders"))
    totals = o.where("o_totalprice > 100000").groupBy("id").agg(F.round(F.max("o_totalprice"), 2).alias("total"))
    df = joins.join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), [counts, totals], "id")
    return df.withColumns({"n_orders": F.coalesce("n_orders", F.lit(0)), "total": F.coalesce("total", F.lit(0.0))})


@query("SELECT k, coalesce(a, 0) AS n_orders, coalesce(b, 0) AS n_customers FROM (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY ALL) FULL JOIN (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k, count(*) AS b FROM customer GROUP BY ALL) USING (k)")
def cogroup_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return joins.cogroups(o, table(spark, d, "customer").select(_elsewhere(3).alias("k")), ["k"], _sizes, "k bigint, n_orders bigint, n_customers bigint")


def _sizes(orders: pa.Table, customers: pa.Table) -> pa.Table:
    """Rows of each key on both sides; null keys of one side are not those of the other, as in SQL."""
    n, m = (t.group_by("k", use_threads=False).aggregate([([], "count_all")]).rename_columns(["k", name]) for t, name in ((orders, "n_orders"), (customers, "n_customers")))
    both = n.join(m, "k", join_type="full outer", use_threads=False)
    return pa.table({c: both["k"] if c == "k" else pc.fill_null(both[c], 0) for c in ("k", "n_orders", "n_customers")})


_SPAN = "SELECT event_id, user_id, event_type, epoch(ts) AS start, epoch(ts) + value AS stop FROM events"
_LONG = _SPAN.replace("+ value", "+ value * 100")


def spans(spark, d, times: int = 1):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", seconds().alias("start"), (seconds() + F.col("value") * times).alias("stop"))


@query(f"WITH s AS ({_LONG}) SELECT a.event_id, b.event_id AS event_id_r FROM s a JOIN s b ON a.user_id = b.user_id AND a.start < b.stop AND b.start < a.stop AND a.event_type = 'error' AND b.event_type = 'click' AND a.start < a.stop AND b.start < b.stop")
def join_interval_overlap(spark, d):
    s = spans(spark, d, 100)
    return joins.overlap(s.where("event_type = 'error'"), s.where("event_type = 'click'"), "start", "stop", 3600.0, ["user_id"]).select("event_id", "event_id_r")


_ERRORS = "(SELECT user_id, ts, max(value) AS err FROM events WHERE event_type = 'error' GROUP BY ALL)"


@query(f"SELECT e.event_id, e.user_id, e.ts, coalesce(r.err, -1) AS err FROM (SELECT * FROM events WHERE event_type <> 'error') e ASOF LEFT JOIN {_ERRORS} r ON e.user_id = r.user_id AND e.ts >= r.ts")
def asof_backward(spark, d):
    e = table(spark, d, "events")
    r = e.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("value").alias("err"))
    return joins.asof(e.where("event_type <> 'error'").select("event_id", "user_id", "ts"), r, "ts", ["user_id"], ["err"], {"err": -1.0})


@query("SELECT e.event_id, e.odd, e.ts, coalesce(r.err, -1) AS err FROM (SELECT event_id, user_id % 2 AS odd, ts FROM events WHERE event_type <> 'error') e ASOF LEFT JOIN (SELECT user_id % 2 AS odd, ts, max(value) AS err FROM events WHERE event_type = 'error' GROUP BY ALL) r ON e.odd = r.odd AND e.ts >= r.ts")
def asof_hot_keys(spark, d):
    """Two groups hold all rows; they are dealt to ranges of time."""
    e = table(spark, d, "events").withColumn("odd", F.col("user_id") % 2)
    r = e.where("event_type = 'error'").groupBy("odd", "ts").agg(F.max("value").alias("err"))
    return joins.asof(e.where("event_type <> 'error'").select("event_id", "odd", "ts"), r, "ts", ["odd"], ["err"], {"err": -1.0}, split=True)


_NEAREST = """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS err FROM events WHERE event_type = 'error' GROUP BY ALL),
b AS (SELECT e.*, r.t AS bt, r.err AS bv FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.t >= r.t),
c AS (SELECT b.*, r.t AS ct, r.err AS cv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t <= r.t)
SELECT event_id, user_id, t, CASE WHEN ct IS NULL OR t - bt <= ct - t THEN bv ELSE cv END AS err FROM c"""


@query(_NEAREST)
def nearest_hot_keys(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    r = e.where("event_type = 'error'").groupBy("user_id", "t").agg(F.max("value").alias("v"))
    return joins.nearest(e.where("event_type <> 'error'").select("event_id", "user_id", "t"), r, "t", ["user_id"], "v", "err", split=True)


@query(f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, epoch_us(ts) AS t, err FROM {_ERRORS}),
b AS (SELECT e.*, r.t AS bt, r.err AS bv FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.t >= r.t),
c AS (SELECT b.*, r.t AS ct, r.err AS cv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t <= r.t)
SELECT event_id, user_id, t, CASE WHEN ct IS NULL OR t - bt <= ct - t THEN bv ELSE cv END AS err FROM c""")
def asof_nearest(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    r = e.where("event_type = 'error'").groupBy("user_id", "t").agg(F.max("value").alias("v"))
    return joins.nearest(e.where("event_type <> 'error'").select("event_id", "user_id", "t"), r, "t", ["user_id"], "v", "err")


@query("SELECT l_returnflag, l_linestatus, count(l_quantity) AS n FROM lineitem GROUP BY ALL")
def group_count(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("l_quantity").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_discount) AS max_disc FROM lineitem GROUP BY ALL")
def group_sum_avg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("min_disc"), F.max("l_discount").alias("max_disc"))


@query("SELECT l_suppkey, round(stddev_samp(l_quantity), 6) AS s FROM lineitem GROUP BY ALL")
def group_std_samp(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("s"))


@query("SELECT l_suppkey, round(stddev_pop(l_quantity), 6) AS s FROM lineitem GROUP BY ALL")
def group_std_pop(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("s"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY ALL")
def group_collect(spark, d):
    df = agg.collect_groups(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey", "keys")
    return df.withColumn("keys", F.array_join(F.transform("keys", lambda x: x.cast("string")), ","))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def grouping_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def grouping_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY ALL")
def histogram40(spark, d):
    return agg.histogram(table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice", 40)


_SHARE = "SELECT user_id, round(total, 4) AS total, round(total / sum(total) OVER (), 8) AS share FROM (SELECT user_id, sum(value) AS total FROM events GROUP BY ALL)"


@query(_SHARE)
def share_of_total(spark, d):
    return agg.share_of_total(table(spark, d, "events"), ["user_id"], F.col("value")).select("user_id", F.round("total", 4).alias("total"), F.round("share", 8).alias("share"))


@query("SELECT event_type, n, share FROM (SELECT event_type, n, round(n / sum(n) OVER (), 8) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE share >= 0.02")
def two_percent_cut(spark, d):
    return agg.share_of_total(table(spark, d, "events"), ["event_type"], F.lit(1), 0.02).select("event_type", F.col("total").alias("n"), F.round("share", 8).alias("share"))


@query("SELECT event_id, CAST(sum(event_id) OVER (ORDER BY event_id) AS BIGINT) AS cumsum FROM events")
def cumsum(spark, d):
    return windows.cumulative_sum(table(spark, d, "events").select("event_id"), "event_id", ["event_id"])


@query("SELECT event_id, user_id, round(CASE WHEN count(value) OVER w = 2 THEN avg(value) OVER w END, 6) AS mean2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def rolling_mean2(spark, d):
    df = windows.rolling_mean(table(spark, d, "events"), "value", ["event_id"], ["user_id"], 2, "mean2")
    return df.select("event_id", "user_id", F.round("mean2", 6).alias("mean2"))


@query("SELECT event_id, round(CASE WHEN dt <> 0 THEN dv / dt END, 6) + 0.0 AS rate FROM (SELECT event_id, epoch(ts) - lag(epoch(ts)) OVER w AS dt, value - lag(value) OVER w AS dv FROM (SELECT user_id, ts, min(event_id) AS event_id, max(value) AS value FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY user_id ORDER BY ts))")
def lag_rate(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"), F.max("value").alias("value")).withColumn("t", seconds())
    return windows.rate(e, "value", "t", ["user_id"], "rate").select("event_id", (F.round("rate", 6) + 0.0).alias("rate"))


@query("SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS stop FROM (SELECT DISTINCT user_id, ts FROM events)")
def lead_intervals(spark, d):
    return windows.intervals(table(spark, d, "events").select("user_id", "ts").distinct(), "ts", ["user_id"])


@query("SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS lane FROM (SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id) AS f FROM events)")
def dense_first_seen(spark, d):
    return windows.dense_by_first(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", "lane").select("event_id", "user_id", "lane")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, d):
    return frames.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def head_k(spark, d):
    return frames.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 5, "o_orderkey")


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5) ORDER BY o_orderkey")
def tail_k(spark, d):
    return frames.tail(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 5, "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def kway_merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return frames.merge_sorted([o.where(f"o_orderkey % 3 = {k}") for k in range(3)], "o_orderdate", "o_orderkey")


@query("SELECT event_id, value FROM events WHERE event_id >= 100 ORDER BY event_id LIMIT 50")
def slice_after(spark, d):
    return frames.after(table(spark, d, "events").select("event_id", "value"), "event_id", 100, 50)


_DUP = "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {}) AS r FROM events) WHERE r = 1"


@query(_DUP.format(""))
def drop_dup_first(spark, d):
    return frames.drop_duplicates(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"])


@query(_DUP.format("DESC"))
def drop_dup_last(spark, d):
    return frames.drop_duplicates(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"], "last")


def _keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def union_all(spark, d):
    return frames.concat(_keys(spark, d))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def union_distinct(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b)


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def except_(spark, d):
    a = table(spark, d, "orders").where("o_totalprice > 250000").select("o_custkey")
    return _keys(spark, d)[1].subtract(a)

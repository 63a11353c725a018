"""Operators against small worked examples, pandas and numpy."""

import time
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft import sources
from weft.functions import scalar, user
from weft.futures import Client, as_completed, wait
from weft.operators import aggregates, arrays, exchange, frames, intervals, joins, telemetry, windows
from weft.plans import QUERIES, SQL
from weft.streaming import feeds


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


A = [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4)]
B = [(1, 6), (3, 5), (4, 4), (4, 3), (5, 2), (6, 1)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merge_as_pandas(spark, how):
    a, b = pd.DataFrame(A, columns=["x", "y"]), pd.DataFrame(B, columns=["y", "z"])
    want = a.merge(b, on="y", how=how)
    got = joins.merge(spark.createDataFrame(A, "x long, y long"), spark.createDataFrame(B, "y long, z long"), how, on=["y"]).toPandas()
    key = lambda f: sorted(f.fillna(-1).astype("int64").itertuples(index=False, name=None))
    assert key(got[list(want.columns)]) == key(want)


def test_merge_null_keys(spark):
    a, b = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long"), spark.createDataFrame([(None, 3), (5, 4)], "k long, w long")
    assert joins.merge(a, b, on=["k"]).count() == 0
    assert rows(joins.merge(a, b, on=["k"], null_equal=True)) == [(None, 1, 3)]
    got = joins.merge(a, b, "outer", on=["k"], indicator="side").groupBy("side").count()
    assert dict(rows(got)) == {"left_only": 2, "right_only": 2}


def test_merge_many_to_many_and_partitions(spark):
    a = spark.createDataFrame([(k, 1) for k in (4, 2, 3) * 10], "a long, b long")
    b = spark.createDataFrame([(k, 1) for k in (4, 2, 3) * 10], "a long, c long")
    df = joins.merge(a, b, on=["a"], partitions=5)
    assert df.count() == 300 and df.rdd.getNumPartitions() == 5


def test_merge_errors(spark):
    a = spark.range(1)
    with pytest.raises(ValueError):
        joins.merge(a, a.withColumnRenamed("id", "x"))
    with pytest.raises(ValueError):
        joins.merge(a, a, how="cross", on=["id"])


def test_asof_steps(spark):
    left = spark.createDataFrame([(1, float(x)) for x in (-1, 0, 1, 2.9, 3, 4, 5)], "g long, x double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b"), (1, 3.0, "c")], "g long, x double, f string")
    got = joins.asof(left, right, "x", ["g"], ["f"], {"f": "-"}).orderBy("x").collect()
    assert "".join(r.f for r in got) == "--abccc"
    assert "".join(r.f for r in joins.asof(left, right.limit(0), "x", ["g"], ["f"], {"f": "-"}).collect()) == "-" * 7


def test_nearest_ties_go_back(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (1, 11)], "g long, t long")
    right = spark.createDataFrame([(1, 4, "a"), (1, 6, "b"), (1, 20, "c")], "g long, t long, v string")
    assert [r.n for r in joins.nearest(left, right, "t", ["g"], "v", "n").orderBy("t").collect()] == ["a", "a", "b"]


def test_overlap_each_pair_once(spark):
    rng = np.random.default_rng(0)
    a = [(i, float(s), float(s + w)) for i, (s, w) in enumerate(rng.uniform(0, 50, (60, 2)))]
    df = spark.createDataFrame(a, "id long, s double, e double")
    want = sorted((x[0], y[0]) for x in a for y in a if x[1] < y[2] and y[1] < x[2])
    assert rows(joins.overlap(df, df, "s", "e", 7.0).select("id", "id_r")) == sorted(want, key=str)


def test_exchange(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3), (5, 1), (6, 9), (7, None)], "x long, p int")
    out = exchange.exchange(df, "p", 4, drop=False).withColumn("at", F.spark_partition_id()).collect()
    assert sorted(r.x for r in out) == [1, 2, 3, 4, 5] and all(r.p == r.at for r in out)
    assert exchange.exchange(df, "p", 4, [0]).count() == 0
    stable = spark.createDataFrame([(i, i % 23) for i in range(1000)], "a long, b int")
    parts = exchange.exchange(stable.repartition(19), "b", 23, order=["a"]).rdd.glom().collect()
    assert all([r.a for r in p] == sorted(r.a for r in p) for p in parts) and len(parts) == 23


def test_set_index_divisions(spark):
    df = spark.createDataFrame([(i, 1) for i in range(1, 9)], "a long, b long")
    assert [[r.a for r in p] for p in exchange.set_index(df, "a", (1, 3, 8)).rdd.glom().collect()] == [[1, 2], [3, 4, 5, 6, 7, 8]]
    assert exchange.set_index(df, "a", partitions=3).select("a").rdd.map(lambda r: r.a).collect() == list(range(1, 9))


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c"), (None, 4, "d")], "k long, t long, v string")
    assert rows(frames.drop_duplicates(df, ["k"], ["t"])) == sorted([(1, 1, "a"), (None, 3, "c")], key=str)
    assert rows(frames.drop_duplicates(df, ["k"], ["t"], "last")) == sorted([(1, 2, "b"), (None, 4, "d")], key=str)


def test_frames(spark):
    df = spark.range(10).withColumn("c", F.when(F.col("id") % 3 != 0, F.concat(F.lit("v"), F.col("id") % 3)))
    assert frames.size(df) == 20
    assert frames.isin(df, "id", [*range(2000), None]).count() == 10 and frames.isin(df, "id", [3, 4]).count() == 2
    assert dict(frames.categorize(df, "c", "code").select("c", "code").distinct().collect()) == {None: -1, "v1": 0, "v2": 1}
    assert frames.concat([df, spark.range(2).withColumn("z", F.lit(1))]).columns == ["id", "c", "z"]
    assert [r.id for r in frames.tail(df, 3, "id").collect()] == [7, 8, 9]


def test_cumulative_sum_without_groups(spark):
    df = spark.range(1000).repartition(7)
    got = {r.id: r.cumsum for r in windows.cumulative_sum(df, "id", ["id"]).collect()}
    assert got == dict(enumerate(np.cumsum(np.arange(1000)).tolist()))


def test_overlapping_mirrors(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(4)], "g long, i long, v double")
    got = [list(r.w) for r in windows.overlapping(df, "v", ["i"], ["g"], 2, "w").orderBy("i").collect()]
    want = np.pad(np.arange(4.0), 2, mode="symmetric")
    assert got == [want[i : i + 5].tolist() for i in range(4)]


def test_ewma_is_the_fold(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0]
    now = v[0]
    for x in v[1:]:
        now = 0.5 * x + 0.5 * now
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i long, v double")
    assert aggregates.ewma(df, ["k"], ["i"], "v").first().ewma == pytest.approx(now)


def test_histogram_of_equal_values(spark):
    assert rows(aggregates.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), "x")) == [(0, 2)]


def test_sum_mappings(spark):
    df = spark.createDataFrame([({"x": 1.0, "y": 1.2},), ({"w": 7.0, "y": 3.4},)], "m map<string,double>")
    assert {k: round(v, 6) for k, v in aggregates.sum_mappings(df, "m").collect()} == {"x": 1.0, "y": 4.6, "w": 7.0}


def test_interval_union_and_integral(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.0, 3.5), (1, 5.0, 6.0), (1, 7.0, 7.0)], "g long, s double, e double")
    assert rows(intervals.active(df, "s", "e", ["g"])) == [(1, 0.0, 3.5, 2), (1, 5.0, 6.0, 1)]
    assert rows(intervals.allocate(df, "s", "e", 2.0, ["g"])) == [(1, 0, 3.0), (1, 1, 1.5), (1, 2, 1.0)]
    steps = spark.createDataFrame([(1, 0.0, 3.0, 10.0), (1, 4.0, 7.0, 10.0)], "g long, t double, n double, until double")
    assert intervals.step_integral(steps, "t", "n", ["g"]).first().integral == 12.0


def test_align(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 2.0), ("b", 2, 5.0), ("b", 2, 6.0)], "s string, t long, v double")
    assert rows(intervals.align(df, "s", "t", "v", ["a", "b"])) == [(1, 1.0, None), (2, 1.0, 6.0), (3, 2.0, None)]


def test_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(10, 30))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(10) for j in range(30)], "i long, j long, v double")
    old, new = ([1, 2, 3, 4], [5] * 6), ([5, 5], [15, 15])
    back = arrays.from_blocks(arrays.rechunk(arrays.to_blocks(cells, *old), old, new), *new).collect()
    y = np.zeros_like(x)
    for i, j, v in back:
        y[i, j] = v
    assert (x == y).all() and len(back) == 300
    dot = {(i, j): v for i, j, v in arrays.dot(cells, arrays.transpose(cells)).collect()}
    assert all(v == pytest.approx((x @ x.T)[k]) for k, v in dot.items())
    assert {k: s for k, _, s, _ in arrays.along(cells, 0).collect()} == {j: pytest.approx(x[:, j].std()) for j in range(30)}


def test_chunks():
    assert arrays.overlaps([10] * 5, [25, 5, 20]) == [[(0, 0, 10), (1, 0, 10), (2, 0, 5)], [(2, 5, 10)], [(3, 0, 10), (4, 0, 10)]]
    assert arrays.even_chunks(10, 4) == [4, 4, 2] and arrays.auto_chunks(20, 8, 64) == [8, 8, 4]
    with pytest.raises(ValueError):
        arrays.overlaps([3], [4])


def test_telemetry(spark):
    spans = spark.createDataFrame([("a", None, ["x"]), ("b", "a", ["x", "y"]), ("c", "b", ["z"])], "span_id string, parent_id string, name array<string>")
    assert rows(telemetry.descendants(spans).groupBy("root").count()) == [("a", 3), ("b", 2), ("c", 1)]
    assert [r.span_id for r in telemetry.by_tags(spans, ["x", "z"]).orderBy("span_id").collect()] == ["a"]
    prof = spark.createDataFrame([(["m", "f"], 2), (["m", "g"], 3), (["m"], 1)], "path array<string>, count long")
    assert {tuple(r.path): r["count"] for r in telemetry.merge_profiles(prof).collect()} == {("m",): 6, ("m", "f"): 2, ("m", "g"): 3}


def test_sources(spark, tmp_path):
    df = sources.from_partitions(spark, lambda k: pd.DataFrame({"x": [k, k + 1]}), [10, 20], "x long")
    assert sorted(r.x for r in df.collect()) == [10, 11, 20, 21] and df.rdd.getNumPartitions() == 2
    ts = sources.time_series(spark, datetime(2000, 1, 1), datetime(2000, 1, 2), 3600)
    assert ts.count() == 24 and ts.agg(F.max("ts")).first()[0] == datetime(2000, 1, 1, 23)
    sources.write_state(spark.createDataFrame([(1, {"a": 2})], "id long, s map<string,long>"), f"{tmp_path}/state")
    assert sources.read_state(spark, f"{tmp_path}/state", "id long, s map<string,long>").first().s == {"a": 2}
    (tmp_path / "r.txt").write_text("a|b|c")
    assert [r.record for r in sources.read_blocks(spark, f"{tmp_path}/r.txt", "|").collect()] == ["a", "b", "c"]
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    assert rows(sources.read_csv(spark, f"{tmp_path}/x.csv", "a int, b string")) == [(1, "x")]
    assert sources.text_lines(spark, f"{tmp_path}/r.txt").count() == 1


def test_conform(spark):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    assert sources.conform(spark.createDataFrame([(1.0, 2)], "a double, b long"), schema).dtypes == [("a", "double"), ("b", "double")]
    with pytest.raises(TypeError, match="incompatible types"):
        sources.conform(spark.createDataFrame([(1.0, "x")], "a double, b string"), schema)
    with pytest.raises(ValueError):
        sources.conform(spark.createDataFrame([(1.0,)], "a double"), schema)


def test_functions(spark):
    assert scalar.duration("1.5 hours") == timedelta(hours=1.5) and scalar.duration("100ms") == timedelta(seconds=0.1) and scalar.duration(3) == timedelta(seconds=3)
    with pytest.raises(ValueError):
        scalar.duration("5 parsecs")
    keys = spark.createDataFrame([("inc-1",), ("sum-0123456789abcdef",), ("('x-abcdef0123456789', 0, 1)",), ("plain",)], "k string")
    assert [r[0] for r in keys.select(scalar.key_group(F.col("k"))).collect()] == ["inc", "sum", "x", "plain"]
    assert [r[0] for r in spark.createDataFrame([(1.0,), (0.001,), (1e9,)], "r double").select(scalar.log2_level(F.col("r"))).collect()] == [6, 0, 14]


def test_user_functions(spark):
    async def _later(x):
        return x * 2

    df = spark.range(5)
    assert sorted(r.y for r in user.concurrently(df, "id", _later, "y", "long").collect()) == [0, 2, 4, 6, 8]
    assert user.rows_from(df, lambda r: ({"n": k} for k in range(r.id)), "n long").count() == 10
    with pytest.raises(TypeError):
        user.by_group(df, [df], len, "n long")


def test_futures(spark):
    with Client(spark) as c:
        fs = c.map(lambda n: spark.range(n).count(), [1, 2, 3])
        assert c.gather(fs) == [1, 2, 3] and {f.result() for f in as_completed(fs)} == {1, 2, 3}
        total = c.submit(lambda a, b: a + b, fs[0], fs[1])
        assert total.result() == 3 and c.submit(lambda: 0, key=total.key) is total
        bad = c.submit(lambda: 1 / 0)
        assert isinstance(bad.exception(), ZeroDivisionError) and bad.status == "error" and c.gather([bad, fs[0]], errors="skip") == [1]
        tries = []
        assert c.submit(lambda: tries.append(1) or (len(tries) < 3 and 1 / 0) or "ok", retries=3).result() == "ok"
        done, rest = wait(fs)
        assert len(done) == 3 and not rest
        c.publish(x=1)
        with pytest.raises(KeyError):
            c.publish(y=2, x=3)
        assert c.published() == ["x"] and c.published("x") == 1
        slow = c.submit(lambda: spark.range(8, numPartitions=8).foreach(lambda _: time.sleep(60)))
        time.sleep(2)
        slow.cancel()
        assert slow.exception(30) is not None and slow.status == "cancelled"


def test_stream_of_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).coalesce(1).write.mode("append").parquet(src)
    seen = []
    q = feeds.every_batch(feeds.follow(spark, src, spark.read.parquet(src).schema, files_at_once=1), lambda df, n: seen.append(df.count()))
    q.awaitTermination()
    assert seen == [10, 10, 10]


def test_descendants_at_any_depth(spark):
    spans = spark.createDataFrame([(i, i - 1 if i else None) for i in range(41)], "span_id long, parent_id long")
    got = telemetry.descendants(spans)
    assert got.where("root = 0").count() == 41 and got.agg({"level": "max"}).first()[0] == 40
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "span_id long, parent_id long")
    with pytest.raises(ValueError):
        telemetry.descendants(ring)


def test_rechunk_of_four_axes(spark):
    rng = np.random.default_rng(1)
    a = rng.random((10, 7, 5, 4))
    old, new = ([4, 4, 2], [7], [2, 3], [4]), ([1, 9], [3, 3, 1], [5], [2, 2])

    def blocks(chunks):
        out = []
        for index in np.ndindex(*map(len, chunks)):
            part = a[tuple(slice(sum(c[:k]), sum(c[: k + 1])) for c, k in zip(chunks, index))]
            out.append((list(index), list(part.shape), part.ravel().tolist()))
        return out

    df = spark.createDataFrame(blocks(old), "index array<int>, shape array<int>, data array<double>")
    got = sorted((list(r["index"]), list(r["shape"]), list(r["data"])) for r in arrays.rechunk_nd(df, old, new).collect())
    assert got == sorted(blocks(new))
    some = arrays.rechunk_nd(df, old, new, keep=lambda k: k[0] == 1 and k[3] == 0).collect()
    assert sorted(list(r["index"]) for r in some) == sorted(x[0] for x in blocks(new) if x[0][0] == 1 and x[0][3] == 0)
    with pytest.raises(ValueError):
        arrays.rechunk_nd(df, old, ([3], [7], [5], [4]))
    x = rng.random((50, 6))
    g = arrays.gram(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(7), "v")
    assert np.allclose([r.v for r in g.orderBy("i", "j").collect()], (x.T @ x).ravel())


def test_numbers_and_alignment_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert rows(windows.numbered(df, ["k"], "n")) == rows(spark.range(1000).select(F.col("id").alias("k"), F.col("id").cast("int").alias("n")))
    rng = np.random.default_rng(2)
    samples = [(int(t), s, float(v)) for t, s, v in zip(rng.integers(0, 5000, 800), rng.choice(["a", "b"], 800), rng.random(800)) if not (s == "b" and t > 2000)]
    got = {r.t: (r.a, r.b) for r in intervals.align(spark.createDataFrame(samples, "t int, s string, v double").repartition(5), "s", "t", "v", ["a", "b"]).collect()}
    wide = pd.DataFrame(samples, columns=["t", "s", "v"]).groupby(["t", "s"]).v.max().unstack().sort_index()
    want = wide.ffill().where(wide[::-1].ffill()[::-1].notna())
    assert got == {int(t): tuple(None if pd.isna(x) else x for x in r) for t, r in zip(want.index, want[["a", "b"]].to_numpy())}


def test_joins_on_an_index(spark):
    left = pd.DataFrame({"v": [1, 2, 3, 4]}, index=pd.Index([1, 1, 2, 5], name="k"))
    right = pd.DataFrame({"w": [10, 20, 30]}, index=pd.Index([1, 2, 9], name="k"))
    a, b = (spark.createDataFrame(x.reset_index()) for x in (left, right))
    for how in ("inner", "left", "right", "outer"):
        want = left.join(right, how=how).reset_index().sort_values(["k", "v"])
        got = joins.join(a, [b], "k", how).toPandas().sort_values(["k", "v"])
        pd.testing.assert_frame_equal(got.reset_index(drop=True).astype(float), want.reset_index(drop=True)[["k", "v", "w"]].astype(float))
    with pytest.raises(ValueError):
        joins.join(a, [a], "k")
    c = b.withColumnRenamed("k", "x")
    assert rows(joins.join_on_index(a, c, ["k"], ["x"], "id")) == [(1, 1, 10), (1, 2, 10), (2, 3, 20)]
    both = joins.cogroup(a, b, ["k"], lambda x, y: pd.DataFrame({"k": [(x if len(x) else y).k.iloc[0]], "n": [len(x) * 10 + len(y)]}), "k long, n long")
    assert rows(both) == [(1, 21), (2, 11), (5, 10), (9, 1)]


def test_set_index_by_sampling_and_head(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"))
    parts = exchange.set_index(df, "k", partitions=4).withColumn("p", F.spark_partition_id())
    edges = sorted((r.lo, r.hi) for r in parts.groupBy("p").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    assert len(edges) > 1 and all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    assert [r.k for r in frames.head(df, 3, "k").collect()] == [0, 1, 2]


def test_paths_tokens_and_sizes(spark):
    df = spark.range(1)
    nested = F.struct(F.struct(F.lit(1).alias("b"), F.array(F.lit(7), F.lit(8)).alias("c")).alias("a"))
    got = df.select(scalar.path_get(nested, "a", "c", 1), scalar.path_get(nested, "a", "c", 5), scalar.path_get(scalar.path_set(nested, F.lit(9), "a", "b"), "a", "b"), scalar.flatten_lists(F.array(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3))))).first()
    assert tuple(got) == (8, None, 9, [1, 2, 3])
    tokens = spark.createDataFrame([("a", None), ("a", "null"), ("a", None), (None, "a")], "x string, y string").select(scalar.key_token(F.col("x"), F.col("y")).alias("t"))
    assert tokens.distinct().count() == 3
    sizes = spark.createDataFrame([(0,), (921,), (922,), (1024**2,), (3 * 1024**3,)], "n long").select(scalar.format_bytes(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["0 B", "921 B", "0.90 kiB", "1.00 MiB", "3.00 GiB"]


def test_metrics_of_subtrees(spark):
    spans = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "span_id long, parent_id long")
    metrics = spark.createDataFrame([(1, "cpu", 1.0), (3, "cpu", 2.0), (3, "io", 5.0)], "span_id long, activity string, value double")
    active = spark.createDataFrame([(1, 10.0), (2, 6.0), (4, 3.0)], "span_id long, active double")
    other = "idle or other spans"
    assert rows(telemetry.subtree_metrics(spans, metrics, active)) == sorted([(1, "cpu", 3.0), (1, "io", 5.0), (2, "cpu", 2.0), (2, "io", 5.0), (3, "cpu", 2.0), (3, "io", 5.0), (1, other, 2.0), (2, other, 0.0), (4, other, 3.0)], key=str)


def test_shared_folder_is_asked_for_on_clusters(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        sources.shared_folder(Cluster)


def test_sources_from_the_driver(spark):
    frame = pd.DataFrame({"a": [1, 2, 3]}, index=[7, 8, 9])
    df = sources.from_pandas(spark, frame, 2, index="k")
    assert rows(df) == [(7, 1), (8, 2), (9, 3)] and df.rdd.getNumPartitions() == 2
    assert rows(sources.from_dict(spark, {"x": [1, 2], "y": ["a", "b"]})) == [(1, "a"), (2, "b")]
    assert rows(sources.from_sequence(spark, [3, None, 5], "long")) == [(3,), (5,), (None,)]
    assert rows(sources.number_range(spark, 2, 9, 3, 2)) == [(2,), (5,), (8,)]


def test_split_groups_as_whole_ones(spark):
    rng = np.random.default_rng(3)
    left = spark.createDataFrame([(int(g), int(t), i) for i, (g, t) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 900), rng.integers(0, 3000, 900)))], "g int, t int, i int")
    right = spark.createDataFrame([(g, t, float(g * 10_000 + t)) for g in (0, 1) for t in sorted(set(rng.integers(0, 3000, 60).tolist()))], "g int, t int, v double")
    left, right = left.union(spark.createDataFrame([(None, 5, -1)], left.schema)).repartition(6), right.repartition(3)
    assert rows(joins.asof(left, right, "t", ["g"], ["v"], split=True)) == rows(joins.asof(left, right, "t", ["g"], ["v"]))
    assert rows(joins.nearest(left, right, "t", ["g"], "v", "n", split=True)) == rows(joins.nearest(left, right, "t", ["g"], "v", "n"))


def test_many_groups_in_one_call(spark):
    made = [(k % 50 if k % 11 else None, float("nan") if k % 7 == 0 else -0.0 if k % 2 else 0.0) for k in range(400)]
    df = spark.createDataFrame(made, "k long, x double")

    def calls(part: pa.Table) -> pa.Table:
        g = part.group_by(["k"], use_threads=False).aggregate([([], "count_all")])
        return pa.table({"k": g["k"], "n": g["count_all"], "groups": pa.array([len(g)] * len(g))})

    got = user.by_groups(df, ["k"], calls, "k long, n long, groups long").collect()
    want = pd.Series([m[0] for m in made]).value_counts(dropna=False)
    assert len(got) == len(want) == 51 and {(r.k, r.n) for r in got} == {(None if np.isnan(k) else int(k), n) for k, n in want.items()}
    assert max(r.groups for r in got) > 5
    # batches of three rows cut no group, whatever its keys hold
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        ends = user.by_groups(df, ["k", "x"], lambda part: pa.table({"n": [len(part)], "k": part["k"][:1]}), "n long, k long").collect()
        assert sum(r.n for r in ends) == 400 and len(ends) <= 153 and max(r.n for r in ends) > 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert user.by_groups(df.limit(0), ["k"], calls, "k long, n long, groups long").collect() == []


def test_many_keys_in_one_call(spark):
    a = spark.createDataFrame([(k // 3, f"a{k}") for k in range(300)] + [(None, "x")], "k long, v string")
    b = spark.createDataFrame([(k, k) for k in range(90, 150)] + [(None, 7)], "k long, v long")

    def calls(x: pa.Table, y: pa.Table) -> pa.Table:
        assert x.column_names == y.column_names == ["k", "v"] and set(map(str, x["v"].to_pylist())) <= {f"a{k}" for k in range(300)} | {"x"}
        return pa.table({"n": [len(x)], "m": [len(y)], "v": pa.array([sum(y["v"].to_pylist())], pa.int64())})

    got = joins.cogroups(a, b, ["k"], calls, "n long, m long, v long").collect()
    assert (sum(r.n for r in got), sum(r.m for r in got), sum(r.v for r in got)) == (301, 61, sum(range(90, 150)) + 7)
    assert len(got) <= 8  # two calls a task


def _tables(spark, folder):
    """Keys of which some are null; values of which one is NaN and one null."""
    key = "CASE WHEN id % 100 > 0 THEN id % 2000 END"
    spark.range(3000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", f"{key} AS user_id", "CASE WHEN id % 7 > 0 THEN 'view' END AS event_type", "CASE id WHEN 1 THEN CAST('NaN' AS double) WHEN 2002 THEN NULL ELSE double(id) END AS value", "'{}' AS props").write.parquet(f"{folder}/events.parquet")
    spark.range(3000).selectExpr("id AS o_orderkey", f"{key} AS o_custkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(3000).selectExpr(f"{key} AS c_custkey").write.parquet(f"{folder}/customer.parquet")


@pytest.mark.parametrize("name", ["cogroup_counts", "group_apply_two_keys"])
def test_group_queries_on_null_keys(spark, tmp_path, name):
    _tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, found.fetchall()))
    assert "FlatMap" not in df._jdf.queryExecution().toString()  # one call for each group

def test_no_sketch_for_each_pair(spark, data):
    plan = QUERIES["approx_distinct"](spark, data)._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "approx_count_distinct" in line and "Aggregate" in line]
    assert keyed and not any("user_id" in line.split("functions=")[0] for line in keyed)


def test_large_division_takes_many_partitions(spark):
    df = spark.createDataFrame([(i,) for i in range(2000)] + [(None,)], "a long").repartition(3)
    parts = [[(r.a, r.d) for r in p] for p in exchange.set_index(df, "a", (0, 3, 5000), partitions=6, into="d").rdd.glom().collect()]
    every = [x for p in parts for x in p]
    assert every == [(None, None)] + [(i, int(i >= 3)) for i in range(2000)]
    assert len(parts) == 6 and max(map(len, parts)) < 1000


def test_set_index_divisions_of_null(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (None, 1, 3000, 10_000)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(QUERIES["set_index_divisions"](spark, str(tmp_path))) == sorted([(None, 0), (1, 0), (3000, 1), (10_000, 2)], key=str)


def _forest(kind):
    rng = np.random.default_rng(5)
    if kind == "chain":
        return [(i, i - 1 if i else None) for i in range(300)]
    if kind == "chain with leaves":
        return [(i, i - 1 if i else None) for i in range(60)] + [(1000 + i, i % 60) for i in range(90)]
    if kind == "tree":
        return [(i, i // 4 if i else None) for i in range(400)]
    # repeated spans, several parents, parents that are no spans, nulls
    return [(i, int(p) if (p := rng.integers(-3, i + 1)) < i else None) for i in range(40)] + [(7, 3), (7, 3), (12, 7), (None, 2), (None, None)]


@pytest.mark.parametrize("kind", ["chain", "chain with leaves", "tree", "odd"])
def test_subtree_sums_are_those_over_pairs(spark, kind):
    spans = spark.createDataFrame(_forest(kind), "span_id long, parent_id long")
    own = spark.createDataFrame([(i, "ab"[i % 2], i if i % 5 else None) for i, _ in _forest(kind) if i is not None and i % 3], "span_id long, k string, v long")
    tree = telemetry.descendants(spans)
    want = tree.join(own, tree.node == own.span_id).groupBy(F.col("root").alias("span_id"), "k").agg(F.sum("v").alias("v"))
    assert rows(telemetry.subtree_sums(spans, own, ["v"], ["k"]).select("span_id", "k", "v")) == rows(want)


def test_subtree_sums_make_no_pairs(spark, monkeypatch):
    made = []
    keep = telemetry.stored
    monkeypatch.setattr(telemetry, "stored", lambda df: made.append(keep(df)) or made[-1])
    spans = spark.createDataFrame([(i, i // 4 if i else None) for i in range(4000)], "span_id long, parent_id long")
    sums = telemetry.subtree_sums(spans, spans.select("span_id", F.lit(1).alias("v")), ["v"])
    assert sums.agg(F.sum("v")).first()[0] == telemetry.descendants(spans).count() > 24_000
    made.clear()
    telemetry.subtree_sums(spans, spans.select("span_id", F.lit(1).alias("v")), ["v"])
    assert sum(df.count() for df in made) < 6 * 4000


def test_subtrees_in_a_ring(spark):
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 0), (4, 3)], "span_id long, parent_id long")
    with pytest.raises(ValueError):
        telemetry.subtree_sums(ring, ring.select("span_id", F.lit(1).alias("v")), ["v"])
    with pytest.raises(ValueError):
        telemetry.at_or_below(ring, ring.where("span_id = 4"))


@pytest.mark.parametrize("kind", ["chain", "chain with leaves", "tree", "odd"])
def test_spans_at_or_below_make_no_pairs(spark, kind, monkeypatch):
    spans = spark.createDataFrame(_forest(kind), "span_id long, parent_id long")
    some = spans.where("span_id % 17 = 3")
    want = telemetry.descendants(spans).join(some.select(F.col("span_id").alias("root")), "root", "left_semi").select("node").distinct()
    monkeypatch.setattr(telemetry, "descendants", None)
    assert rows(telemetry.at_or_below(spans, some)) == rows(want)
    named = spans.withColumn("name", F.array(F.when(F.col("span_id") % 17 == 3, "x").otherwise("y"))).withColumn("v", F.col("span_id"))
    ids = {r.node for r in want.collect()}
    inside = [i for i, _ in _forest(kind) if i in ids]
    assert tuple(telemetry.merge_by_tags(named, ["x"], ["v"]).first()) == (len(inside), sum(inside))


def test_span_queries_on_nulls(spark, tmp_path):
    spark.range(200).selectExpr("CASE WHEN id < 198 THEN id END AS event_id", "id AS user_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "CASE WHEN id % 3 > 0 THEN CASE WHEN id % 40 = 1 THEN 'error' ELSE 'view' END END AS event_type", "CASE WHEN id % 4 > 0 THEN double(id) END AS value", "CASE WHEN id % 5 > 0 THEN concat('{\"k\": ', id, '}') END AS props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("span_nbytes_done", "span_tree"):
        found = con.execute(SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(map(str, map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("name", ["cumulative_worker_metrics", "span_nbytes_done", "span_tree"])
def test_span_queries_list_no_pairs(spark, data, monkeypatch, name):
    monkeypatch.setattr(telemetry, "descendants", None)
    assert QUERIES[name](spark, data).columns

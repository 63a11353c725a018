import math

import numpy as np
import pytest

from weft.llm import topk

SCHEMA = "id long, v array<double>"


def brute(rows, queries, k=5):
    out = []
    for u, (i, x) in queries:
        s = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), j) for w, (j, y) in enumerate(rows) if w != u and len(y) == len(x))[:k]
        out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, every=3, k=5):
    df = spark.createDataFrame([(i, u, [float(a) for a in x]) for u, (i, x) in enumerate(rows)], "id long, u long, v array<double>")
    got = topk.nearest(df.filter(f"id % {every} = 0"), df, k)
    return sorted(map(tuple, got.collect())), brute(rows, [(u, r) for u, r in enumerate(rows) if r[0] % every == 0], k)


def test_by_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-100, 100, 8).tolist()) for i in range(150)] + [(200 + i, [1] * 8) for i in range(20)] + [(300, [1, 2]), (303, [3, 4]), (0, [5] * 8)]
    got, want = run(spark, rows)
    assert got == want


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_EACH", 7)
    monkeypatch.setattr(topk, "ROWS_EACH", 11)
    rng = np.random.default_rng(1)
    got, want = run(spark, [(i, rng.integers(-9, 9, 4).tolist()) for i in range(60)])
    assert got == want


def test_large_numbers(spark):
    rows = [(3, [2**31, 1]), (6, [2**30, -7]), (1, [2**31 - 1, 5]), (2, [-5, 2**31])]
    got, want = run(spark, rows)
    assert got == want


def test_what_takes_part(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [float("nan"), 1.0]), (3, [math.inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (50, [0.25, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.vec_id: list(r.v) for r in topk.quantise(df).collect()} == {0: [128.0, -1.0], 50: [64.0, 64.0]}


@pytest.mark.parametrize("rows", [[], [(3, [1, 2])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(i, u, [float(a) for a in x]) for u, (i, x) in enumerate(rows)], "id long, u long, v array<double>")
    assert topk.nearest(df, df).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [(50, [1e18, 1e18]), (1, [1e18, 0.0]), (2, [-1e18, -1e18]), (3, [1e-3, 0.0]), (4, [1e307, 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = topk.quantise(df).selectExpr("vec_id AS id", "monotonically_increasing_id() AS u", "v").cache()
    got = sorted(map(tuple, topk.nearest(q.filter("id = 50"), q).collect()))
    most = (1 << 63) - 1
    assert got == [(50, 1, 1, most), (50, 2, 4, most), (50, 3, 3, 0), (50, 4, 2, -most - 1)]


def test_seeds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 20)
    monkeypatch.setattr(topk, "ROWS_LEAST", 16)
    rng = np.random.default_rng(4)
    got, want = run(spark, [(i, rng.integers(-3, 3, 5).tolist()) for i in range(200)])
    assert got == want

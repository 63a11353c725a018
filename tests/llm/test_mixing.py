import random

import numpy as np
import pytest

from weft.llm import mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
        if not free:
            return out


def docs(seed, n=1500):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", "b", "b", "C", None, "é"]), int(rng.lognormvariate(4, 1.2))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_totals(spark, seed):
    rows = docs(seed)
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.copies(df).collect()
    assert len(got) == len(rows)
    of = {i: (s, n) for i, s, n in rows}
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        s, n = of[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.copies <= 2
        taken[s] += n * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.002 * want[s]), s
    again = mixing.copies(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 1000, 500)
    q = mixing.flight(np.full(500, 0.3), size, rng.random(500))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(150) and (q * size).sum() == pytest.approx(0.3 * size.sum())


def test_inclusion_is_on_average_right():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 40)
    hits = np.mean([mixing.flight(np.full(40, 0.4), size, rng.random(40)) for _ in range(2000)], axis=0)
    assert abs(hits - 0.4).max() < 0.06


def test_odd_tables(spark):
    schema = "doc_id long, source string, size long"
    assert mixing.copies(spark.createDataFrame([], schema)).collect() == []
    zero = mixing.copies(spark.createDataFrame([(1, "a", 0), (1, "a", 0), (2, None, None)], schema)).collect()
    assert len(zero) == 3 and all(r.copies == 0 and r.target == 0 for r in zero)
    one = mixing.copies(spark.createDataFrame([(1, "a", 10)], schema)).first()
    assert one.target == 15.0 and one.copies in (1, 2)


def test_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    df = spark.createDataFrame(docs(3, 800), "doc_id long, source string, size long")
    got = mixing.copies(df)
    sums = got.selectExpr("target", "copies * size AS taken").groupBy("target").sum("taken").collect()
    assert got.count() == 800 and all(abs(t - s) <= max(8, 0.005 * t) for t, s in sums)


def test_mixed_repeats_rows(spark):
    rows = [(i, "word " * (i % 7 + 1), s, 1) for i, s, _ in docs(4, 200)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string, n_chars long")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(v for k, v in counts.items() if k >= 5) <= 2 and max(counts.values()) <= 4


def test_clashing_columns_stay(spark):
    names = "rid copies size turn copy _k _n _s target source_size _block"
    rows = [(i, "w " * (5 + i % 7), "abc"[i % 3], *range(11)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names.split()))
    got = mixing.mixed(df)
    assert got.columns == df.columns
    out = got.collect()
    assert set(map(tuple, out)) <= set(rows) and 0 < len(out) <= 120


def test_keys_of_any_type_and_size(spark):
    rows = [(f"{i}-" + "k" * 3000, 5 + i % 7, "ab"[i % 2]) for i in range(300)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id string, size long, source string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)

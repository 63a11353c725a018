import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.llm import jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(n):
        for y in range(x + 1, n):
            both = len(sets[x] & sets[y])
            if both and 5 * both >= 4 * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    groups = {}
    for x in range(n):
        groups.setdefault(find(x), []).append(docs[x][0])
    return sorted((docs[x][0], min(groups[find(x)]), links[x]) for x in range(n))


def near_copies(seed, groups=6, copies=12):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(rng.randint(5, 150))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            out.append(" ".join(w))
    return out


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit("x"))
    return sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect())


def test_by_brute_force(spark):
    texts = near_copies(1) + [None, "", "  ", "one two", "one  two", "a b c d e", "a b c d e", "word " * 50, "word " * 60, "z" * 50_000]
    docs = list(enumerate(texts))
    assert run(spark, docs) == brute(docs)


def test_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 5)
    docs = list(enumerate(near_copies(2, groups=2, copies=40)))
    assert run(spark, docs) == brute(docs)


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SET_BYTES", 4000)
    docs = list(enumerate(near_copies(3, groups=2, copies=30)))
    assert run(spark, docs) == brute(docs)


def test_clashing_columns_stay(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, t, 5, "s", 6), (2, t, 7, "s", 8), (3, None, 9, "s", 1)], "doc_id long, text string, rid int, stays string, class int")
    assert sorted(map(tuple, jaccard.keep_first(df).collect())) == [(1, t, 5, "s", 6), (3, None, 9, "s", 1)]
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_repeated_and_null_keys(spark):
    t = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(7, t), (7, t), (3, t + " x"), (None, t), (9, "else where is it all")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(7, 3, 3), (7, 3, 3), (3, 3, 3), (None, 3, 3), (9, 9, 0)], key=str)
    kept = sorted(r.doc_id for r in jaccard.keep_first(rows).collect())
    assert kept == [3, 9]


def test_keep_first_takes_one_of_equal_rows(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, t, "s"), (1, t, "s"), (2, t, "s"), (4, "", "s"), (4, "", "s")], "doc_id long, text string, source string")
    assert sorted(map(tuple, jaccard.keep_first(df).collect())) == [(1, t, "s"), (4, "", "s"), (4, "", "s")]


def test_descent_reaches_the_recall_and_leaves_crowded_nodes_deep():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 5000, (200, jaccard.TREES, jaccard.DEPTH - jaccard.SHORTEST + 1)), 2)[:, :, ::-1].astype(float)
    sizes[:, :4] = 1  # no company in four trees
    depth = jaccard.descend(sizes)
    assert (jaccard.missed(depth) <= np.log1p(-jaccard.RECALL)).all()
    assert (depth[:, :4] == jaccard.SHORTEST).all() and (depth[:, 4:] > jaccard.SHORTEST).any()


def test_measured_recall_of_the_forest():
    rng, texts = random.Random(5), []
    for g in range(1500):  # pairs of similarity 0.8 to 0.84
        w = [f"g{g}w{k}" for k in range(49)]
        texts += [" ".join(w), " ".join(w[:-5] + [f"x{rng.random()}" for _ in range(5)])]
    sets = [shingles(t) for t in texts]
    assert all(0.8 <= len(a & b) / len(a | b) <= 0.84 for a, b in zip(sets[::2], sets[1::2], strict=True))
    sig = np.frombuffer(b"".join(jaccard._signed(pa.array(texts))[2].to_pylist()), np.uint16).reshape(len(texts), jaccard.TREES, jaccard.DEPTH)
    depth = jaccard.descend(np.full((1500, jaccard.TREES, jaccard.DEPTH - jaccard.SHORTEST + 1), 2.0))
    same = np.minimum.accumulate(sig[::2] == sig[1::2], 2).sum(2)
    assert (same >= depth).any(1).mean() >= 0.999


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "a long, b long")
    got = dict(map(tuple, jaccard.components(edges).collect()))
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000}


def test_empty_table(spark):
    assert run(spark, [(1, "x")])[0] == (1, 1, 0)
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []

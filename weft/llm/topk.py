"""Exact top-k search by inner product with pivot tables.

Every vector keeps its distances to fixed pivots. By the triangle inequality the distance of a query to a candidate
is at least the greatest difference of their distances to a pivot, so their inner product is at most
(|q|**2 + |x|**2 - bound**2) / 2. A query takes its candidates in the order of these bounds and stops when the next
bound is below its k-th score.

A query begins with a score that its k-th is sure to reach, from the rows of the sample that the pivots come from, and
carries it to each block of candidates; what can't reach it is never sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, table

#: Pivots of each vector length, at most so many; rows of the sample they are chosen from, each farthest from those before.
PIVOTS, SAMPLE = 32, 1024
#: Queries and candidates of a block, and so many of these at least. Each pair of blocks is a task's group.
QUERIES_EACH, ROWS_EACH, ROWS_LEAST = 8192, 16384, 2048
#: Candidates that a query looks at between two tests for the end.
STEP = 64
#: Sums beyond this aren't exact in doubles and are made from Python's whole numbers. Scores end at those of 64 bits.
EXACT, GREATEST = 2.0**53, (1 << 63) - 1
#: Vectors are floor(SCALE * x).
SCALE, END = 256, float(np.finfo(np.float64).max)


def quantise(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``v``, whole numbers as doubles, of the rows whose vector is not null and holds finite numbers only.

    Numbers that would leave the range of doubles stay at its ends.
    """
    x = lambda v: v.cast("double")
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < float("inf")))
    # floor() of doubles gives a long, which holds no more; beyond that doubles are whole anyway
    whole = F.transform(F.col(vector), lambda v: F.when(F.abs(x(v)) < 2.0**52, F.floor(x(v) * SCALE).cast("double")).otherwise(F.greatest(F.lit(-END), F.least(F.lit(END), x(v) * SCALE))))
    return df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).filter(fine).select(F.col(key).cast("bigint").alias(key), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class Sample:
    """Vectors of one length, the rows that they are of, and those of them that are pivots."""

    v: np.ndarray
    u: np.ndarray
    pivots: np.ndarray


def choose_pivots(df: DataFrame) -> dict[int, Sample]:
    """Up to ``PIVOTS`` vectors of each length, from the ``SAMPLE`` rows that have the least hash. A length without any has none."""
    by: dict[int, list] = {}
    for row in df.select("v", "u", F.xxhash64("v", "u").alias("h")).orderBy("h").limit(SAMPLE).collect():
        by.setdefault(len(row.v), []).append((row.v, row.u))
    out = {}
    for d, rows in by.items():
        x = np.array([v for v, _ in rows], np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            chosen = [0]
            far = np.linalg.norm(x - x[0], axis=1)
            while len(chosen) < min(PIVOTS, len(x)) and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[d] = Sample(x, np.array([u for _, u in rows], np.int64), x[chosen])
    return out


def _is_exact(q: np.ndarray, x: np.ndarray) -> bool:
    with np.errstate(over="ignore"):
        return bool(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < EXACT and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < EXACT)


def _seed(q: np.ndarray, qu: np.ndarray, sample: Sample | None, k: int) -> np.ndarray:
    """A score that the k-th of each query reaches: that of the sample's k-th. None if the sample is too small."""
    if sample is None or len(sample.v) <= k or not _is_exact(q, sample.v):
        return np.full(len(q), -np.inf)
    out = np.empty(len(q))
    for a in range(0, len(q), 1024):
        s = q[a : a + 1024] @ sample.v.T
        s[qu[a : a + 1024, None] == sample.u[None]] = -np.inf
        out[a : a + 1024] = np.partition(s, -k, axis=1)[:, -k]
    return out


def _search(k: int):
    """Top k of each query among one block of candidates."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
            qd, xd = _matrix(left.column("far").combine_chunks()), _matrix(right.column("far").combine_chunks())
            qi, qu, xi, xu = (t.column(c).to_numpy() for t in (left, right) for c in ("id", "u"))
            seed = left.column("least").to_numpy()
            if not _is_exact(q, x):
                out = _plainly(q, x, qi, qu, xi, xu, k)
            else:
                q2, x2, xd = (q * q).sum(1), (x * x).sum(1), np.ascontiguousarray(xd.T)
                for i in range(len(q)):
                    bound = np.abs(xd[0] - qd[i, 0])
                    for p in range(1, len(xd)):
                        np.maximum(bound, np.abs(xd[p] - qd[i, p]), out=bound)
                    most = (q2[i] + x2 - bound * bound) / 2 + 1e-6 * (1 + q2[i] + x2)  # rounding never makes it too low
                    rest = np.flatnonzero((most >= seed[i]) & (xu != qu[i]))
                    rest = rest[np.argsort(-most[rest], kind="stable")]
                    best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
                    a, step = 0, STEP
                    while a < len(rest):
                        part = rest[a : a + step]
                        if len(best_s) >= k and most[part[0]] < best_s[k - 1]:
                            break
                        s = np.concatenate([best_s, x[part] @ q[i]])
                        ids = np.concatenate([best_i, xi[part]])
                        o = np.lexsort((ids, -s))[:k]
                        best_s, best_i = s[o], ids[o]
                        a += step
                        step *= 2
                    out += [(qu[i], qi[i], int(v), int(s)) for v, s in zip(best_i, best_s, strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("qu", "query_id", "vec_id", "score"), cols, strict=True)})

    return work


def _plainly(q, x, qi, qu, xi, xu, k) -> list[tuple]:
    """With numbers so large that doubles don't hold the sums. Scores outside 64 bits count as the nearest of these."""
    out = []
    whole = [[int(v) for v in row] for row in x.tolist()]
    for i, row in enumerate(q.tolist()):
        r = [int(v) for v in row]
        score = lambda w: min(max(sum(a * b for a, b in zip(r, w, strict=True)), -GREATEST - 1), GREATEST)  # noqa: B023, E731
        s = sorted((-score(w), int(v)) for w, v, u in zip(whole, xi, xu, strict=True) if u != qu[i])[:k]
        out += [(qu[i], qi[i], v, -n) for n, v in s]
    return out


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest inner products of each query with the rows of ``vectors`` but its own.

    Both have ``id``, ``u`` (what identifies a row) and ``v``; a query looks at vectors of its own length, and empty
    vectors take no part. Ties go to the smaller id, rows that repeat an id are rows of their own. Scores outside 64
    bits are the nearest of these. Fewer candidates give fewer rows, empty tables none. The result has ``query_id rank
    vec_id score``. Both sides are dealt to blocks, and each block of queries meets each block of vectors in a group
    of bounded size. The sample that goes to all tasks has ``SAMPLE`` rows.
    """
    spark = vectors.sparkSession
    sample = spark.sparkContext.broadcast(choose_pivots(vectors.filter(F.size("v") > 0)))

    def far(seeded: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = np.array([len(v) for v in batch.column("v").to_pylist()], np.int64)
                for d in np.unique(size):
                    part = batch.filter(pa.array(size == d))
                    x, own = _matrix(part.column("v")).reshape(part.num_rows, int(d)), sample.value.get(int(d))
                    with np.errstate(over="ignore", invalid="ignore"):
                        dist = np.stack([np.linalg.norm(x - y, axis=1) for y in own.pivots], 1) if own else np.zeros((part.num_rows, 1))
                    part = part.append_column("far", pa.array(list(dist), pa.list_(pa.float64())))
                    yield part.append_column("least", pa.array(_seed(x, part.column("u").to_numpy(), own, k))) if seeded else part

        return work

    shape = "id bigint, u bigint, v array<double>, far array<double>"
    vectors = cut(vectors.select("id", "u", "v").filter(F.size("v") > 0).mapInArrow(far(False), shape))
    queries = cut(queries.select("id", "u", "v").filter(F.size("v") > 0).mapInArrow(far(True), f"{shape}, least double"))
    rows, least = vectors.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    nq, nx = max(1, -(-queries.count() // QUERIES_EACH)), max(1, -(-rows // ROWS_EACH), min(least, -(-rows // ROWS_LEAST)))
    deal = lambda df, own, n, other, m: df.withColumns({"d": F.size("v"), own: F.pmod(F.xxhash64("u"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    a, b = deal(queries, "qb", nq, "xb", nx), deal(vectors, "xb", nx, "qb", nq)
    keys = ["d", "qb", "xb"]
    some = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_search(k), "qu bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("qu").orderBy(F.desc("score"), "vec_id"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = cut(rows.select(F.col("vec_id").alias("id"), F.monotonically_increasing_id().alias("u"), "v"))
    return nearest(rows.filter("id % 50 = 0"), rows)


QUERIES = {"op8_exact_topk": op8_exact_topk}
ORACLE_SQL = {
    "op8_exact_topk": """
WITH e AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.u AS u, q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
  FROM e q JOIN e x ON q.u <> x.u AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}

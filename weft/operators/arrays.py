"""Arrays in coordinate form (a row for each cell) and in blocks (a row for each block)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame, row: str, values: str) -> DataFrame:
    """``i j v`` of a column of arrays; null arrays and cells are left out."""
    return df.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "v")).where("v IS NOT NULL").select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of both, added up; a cell that one lacks counts as 0."""
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: joined on the inner index, summed by the outer ones."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("w"))
    return a.join(right, a.j == right.k).groupBy("i", "j2").agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("i", F.col("j2").alias("j"), "v")


def along(a: DataFrame, axis: int) -> DataFrame:
    """Mean, population deviation and sum along an axis: ``k mean std sum``, ``k`` the index that is left."""
    k = "j" if axis == 0 else "i"
    return a.groupBy(F.col(k).alias("k")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.sum("v").alias("sum"))


def without_mean(a: DataFrame, axis: int) -> DataFrame:
    """Each cell less the mean along the axis: one aggregation and a join on its result."""
    k = "j" if axis == 0 else "i"
    means = a.groupBy(k).agg(F.avg("v").alias("_m"))
    return a.join(means, k).select("i", "j", (F.col("v") - F.col("_m")).alias("v"))


def concatenate(arrays: Sequence[tuple[DataFrame, int]], axis: int = 0) -> DataFrame:
    """Arrays one after the other; each comes with its length along the axis."""
    k, out, at = "i" if axis == 0 else "j", None, 0
    for a, n in arrays:
        part = a.withColumn(k, F.col(k) + at)
        out, at = part if out is None else out.unionByName(part), at + n
    return out


def bounds(chunks: Sequence[int]) -> list[int]:
    return [0, *np.cumsum(chunks).tolist()]


def even_chunks(length: int, size: int) -> list[int]:
    """Chunks of ``size``, the last one what is left."""
    return [size] * (length // size) + ([length % size] if length % size else [])


def auto_chunks(length: int, item_bytes: int, most_bytes: int) -> list[int]:
    """As few even chunks as keep below a number of bytes."""
    return even_chunks(length, max(1, min(length, most_bytes // max(1, item_bytes)))) if length else []


def overlaps(old: Sequence[int], new: Sequence[int]) -> list[list[tuple[int, int, int]]]:
    """For each new chunk of an axis the parts it is made of: old chunk, start and stop in it."""
    if sum(old) != sum(new):
        raise ValueError("chunks have to add up to the same length")
    a, b = bounds(old), bounds(new)
    return [[(k, max(lo, a[k]) - a[k], min(hi, a[k + 1]) - a[k]) for k in range(len(old)) if max(lo, a[k]) < min(hi, a[k + 1])] for lo, hi in zip(b[:-1], b[1:], strict=True)]


def to_blocks(a: DataFrame, rows: Sequence[int], columns: Sequence[int]) -> DataFrame:
    """``bi bj shape data`` (row by row) of an array given by cells; missing cells are 0. A block has to fit in a task."""
    r, c = bounds(rows), bounds(columns)
    placed = a.withColumns({"bi": _chunk_of("i", rows), "bj": _chunk_of("j", columns)})

    def build(part: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(part.bi.iloc[0]), int(part.bj.iloc[0])
        block = np.zeros((rows[bi], columns[bj]))
        block[part.i - r[bi], part.j - c[bj]] = part.v
        return pd.DataFrame({"bi": [bi], "bj": [bj], "shape": [list(block.shape)], "data": [block.ravel()]})

    return placed.groupBy("bi", "bj").applyInPandas(build, "bi int, bj int, shape array<int>, data array<double>")


def _chunk_of(index: str, chunks: Sequence[int]) -> Column:
    """The chunk that holds an index: by division where all but the last are alike."""
    if len(set(chunks[:-1])) <= 1 and chunks[-1:] <= chunks[:1]:
        return F.floor(F.col(index) / (chunks[0] if chunks else 1)).cast("int")
    edges = F.array(*map(F.lit, bounds(chunks)[1:-1]))
    return F.size(F.filter(edges, lambda e: e <= F.col(index))).cast("int")


def rechunk_nd(blocks: DataFrame, old: Sequence[Sequence[int]], new: Sequence[Sequence[int]], keep: Callable[[tuple[int, ...]], bool] | None = None) -> DataFrame:
    """Blocks ``index shape data`` of any number of axes on another grid.

    An old block is cut, where it lies, at the edges of the new grid, and each part goes to its new block. With ``keep``
    only new blocks whose index it accepts are made; parts of others are not sent.
    """
    for o, n in zip(old, new, strict=True):
        if sum(o) != sum(n):
            raise ValueError("chunks have to add up to the same length")
    before, after = [np.array(bounds(o)) for o in old], [np.array(bounds(n)) for n in new]

    def split(frames):
        for frame in frames:
            out = []
            for index, data in zip(frame["index"], frame["data"], strict=True):
                low, high = [e[k] for e, k in zip(before, index, strict=True)], [e[k + 1] for e, k in zip(before, index, strict=True)]
                block = np.asarray(data).reshape([b - a for a, b in zip(low, high, strict=True)])
                ranges = [range(int(np.searchsorted(e, a, "right")) - 1, int(np.searchsorted(e, b, "left"))) if b > a else () for e, a, b in zip(after, low, high, strict=True)]
                for target in itertools.product(*ranges):
                    if keep and not keep(target):
                        continue
                    a = [max(lo, e[k]) for lo, e, k in zip(low, after, target, strict=True)]
                    b = [min(hi, e[k + 1]) for hi, e, k in zip(high, after, target, strict=True)]
                    part = block[tuple(slice(x - lo, y - lo) for x, y, lo in zip(a, b, low, strict=True))]
                    out.append((list(target), [int(x - e[k]) for x, e, k in zip(a, after, target, strict=True)], list(part.shape), part.ravel()))
            yield pd.DataFrame(out, columns=["index", "at", "shape", "data"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        index = [int(k) for k in part["index"].iloc[0]]
        block = np.zeros([n[k] for n, k in zip(new, index, strict=True)])
        for at, shape, data in zip(part["at"], part["shape"], part["data"], strict=True):
            block[tuple(slice(x, x + n) for x, n in zip(at, shape, strict=True))] = np.asarray(data).reshape(tuple(shape))
        return pd.DataFrame({"index": [index], "shape": [list(block.shape)], "data": [block.ravel()]})

    parts = blocks.mapInPandas(split, "index array<int>, at array<int>, shape array<int>, data array<double>")
    return parts.groupBy("index").applyInPandas(join, "index array<int>, shape array<int>, data array<double>")


def blockwise(operands: Sequence[DataFrame], function: Callable[..., np.ndarray]) -> DataFrame:
    """Blocks ``bi bj shape data`` of ``function`` of the blocks that lie at the same place in each array."""
    df, names = operands[0].select("bi", "bj", "shape", F.col("data").alias("d0")), [f"d{k}" for k in range(len(operands))]
    for k, other in enumerate(operands[1:], 1):
        df = df.join(other.select("bi", "bj", F.col("data").alias(f"d{k}")), ["bi", "bj"])

    def apply(frames):
        for frame in frames:
            out = []
            for bi, bj, shape, *data in zip(frame.bi, frame.bj, frame["shape"], *(frame[c] for c in names), strict=True):
                made = function(*(np.asarray(x).reshape(tuple(shape)) for x in data))
                out.append((bi, bj, list(made.shape), made.ravel()))
            yield pd.DataFrame(out, columns=["bi", "bj", "shape", "data"])

    return df.mapInPandas(apply, "bi int, bj int, shape array<int>, data array<double>")


def rechunk(blocks: DataFrame, old: tuple[Sequence[int], Sequence[int]], new: tuple[Sequence[int], Sequence[int]]) -> DataFrame:
    """Blocks ``bi bj shape data`` of another grid."""
    made = rechunk_nd(blocks.select(F.array("bi", "bj").alias("index"), "shape", "data"), old, new)
    return made.select(F.col("index")[0].alias("bi"), F.col("index")[1].alias("bj"), "shape", "data")


def gram(df: DataFrame, values: str) -> DataFrame:
    """``i j v`` of transpose(a) times a, the rows of a being arrays of equal length: a partial product for each batch
    of rows, added up."""

    def multiply(frames):
        for frame in frames:
            rows = [x for x in frame[values] if x is not None]
            if rows:
                x = np.array(rows, np.float64)
                i, j = np.indices((x.shape[1],) * 2)
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": (x.T @ x).ravel()})

    return df.select(values).mapInPandas(multiply, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def from_blocks(blocks: DataFrame, rows: Sequence[int], columns: Sequence[int]) -> DataFrame:
    """Cells ``i j v`` of an array in blocks."""
    r, c = F.array(*map(F.lit, bounds(rows))), F.array(*map(F.lit, bounds(columns)))
    flat = blocks.select("bi", "bj", F.col("shape")[1].alias("w"), F.posexplode("data").alias("p", "v"))
    return flat.select((F.get(r, F.col("bi")) + F.floor(F.col("p") / F.col("w"))).cast("bigint").alias("i"), (F.get(c, F.col("bj")) + F.col("p") % F.col("w")).cast("bigint").alias("j"), "v")

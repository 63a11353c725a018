"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes every document floor(r) times, and once more with probability
r - floor(r). The flight phase moves these probabilities along directions that keep the totals of words and of
documents of each source, until each is 0 or 1 but for a few documents. Blocks of a source's documents fly apart from
each other; what they leave over, a few each, flies on together in ever fewer blocks, until the landing phase decides
the last few documents of a source.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import U, cut, fresh, grouped, mix, narrow, table, words_of

#: Weights of the sources in the order of their names, repeating; words to mix as a share of all; most copies of a document.
WEIGHTS, SHARE, COPIES = (5, 2, 1), Fraction(3, 2), 2
#: Rows of a block of the flight; the leftovers of so many blocks come together in the next round.
ROWS, FAN = 1024, 256
#: Documents that a block leaves over; the landing phase decides the last ones of a source by trying all choices.
LANDING = 12
TINY = 1e-9


def targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """Adds ``target`` to one row for each source with its ``source_size``.

    Where a target would be above ``COPIES`` times the source's size, it stops there, and the excess goes to the other
    sources by weight. So all targets are min(COPIES * size, level * weight) with one level, which is found in the
    order in which the sources stop. The windows hold one row for each source.
    """
    names = Window.orderBy(F.col(source).isNull(), source)
    w = F.element_at(F.array(*(F.lit(x) for x in WEIGHTS)), (F.pmod(F.row_number().over(names) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    df = sizes.withColumn("_w", w.cast("double"))
    stops = Window.orderBy(F.col("source_size") / F.col("_w"), F.col(source).isNull(), source)
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    df = df.withColumns({"_all": F.sum("source_size").over(every), "_weights": F.sum("_w").over(every), "_full": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "_gone": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    level = (F.col("_all") * float(SHARE) - COPIES * F.col("_full")) / (F.col("_weights") - F.col("_gone"))
    df = df.withColumn("_level", F.when(COPIES * F.col("source_size") >= level * F.col("_w"), level))
    df = df.withColumn("_level", F.first("_level", ignorenulls=True).over(stops.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.withColumn("target", F.least(F.lit(float(COPIES)) * F.col("source_size"), F.col("_level") * F.col("_w"))).select(source, "source_size", "target")


def flight(p: np.ndarray, size: np.ndarray, chance: np.ndarray, few: int = 2) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 but for two at most. ``chance`` decides between the two ends of each move.

    Triples of undecided documents move side by side; each move decides at least one of three. The flight ends when
    ``few`` or fewer are undecided (2 at least).
    """
    p, turn = p.copy(), 0
    while True:
        left = np.flatnonzero((p > TINY) & (p < 1 - TINY))
        if len(left) <= few:
            return p
        left = left[: min(len(left) - few, len(left) // 3) * 3].reshape(-1, 3)
        x, s = p[left], size[left].astype(np.float64)
        v = np.stack([s[:, 1] - s[:, 2], s[:, 2] - s[:, 0], s[:, 0] - s[:, 1]], 1)  # keeps both totals
        v[(v == 0).all(1)] = (1.0, -1.0, 0.0)  # three of one size: any two can trade
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(v > 0, (1 - x) / v, np.where(v < 0, -x / v, np.inf)).min(1)
            down = np.where(v > 0, x / v, np.where(v < 0, (x - 1) / v, np.inf)).min(1)
        u = (chance[left].sum(1) + turn * 0.6180339887498949) % 1.0
        step = np.where(u * (up + down) < down, up, -down)
        x = np.clip(x + v * step[:, None], 0.0, 1.0)
        x[x < TINY], x[x > 1 - TINY] = 0.0, 1.0
        p[left] = x
        turn += 1


def _land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the last few: the choice whose words come nearest to the expected, then whose number of documents does."""
    left = np.flatnonzero((p > TINY) & (p < 1 - TINY))
    choice = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    words, number = np.abs((choice - p[left]) @ size[left].astype(np.float64)), np.abs((choice - p[left]).sum(1))
    p = p.copy()
    p[left] = choice[np.lexsort((number, np.round(words, 6)))[0]]
    return np.round(p)


def _fly(landing: bool):
    small = {pa.large_binary(): pa.binary(), pa.large_string(): pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "_block"):
            block, p, size, h = (batch.column(c).to_numpy() for c in ("_block", "_p", "_n", "_h"))
            p, schema = p.copy(), pa.schema([(f.name, small.get(f.type, f.type)) for f in batch.schema])
            chance = (mix(h.astype(np.uint64)) >> U(11)) / float(1 << 53)
            edge = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                q = flight(p[a:b], size[a:b], chance[a:b], LANDING)
                p[a:b] = _land(q, size[a:b]) if landing else q
            yield from narrow(batch.set_column(batch.schema.get_field_index("_p"), "_p", pa.array(p)), schema)

    return work


def copies(docs: DataFrame, key: str = "doc_id", size: str = "size", source: str = "source") -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``COPIES``) of every row.

    Reruns over the same rows agree: blocks and chances come from hashes of ``key`` and ``size``. A null source is one
    of its own, and comes last; a null size is 0. A source without words has the target 0 and is not taken. Rows that
    repeat a key are rows of their own; an empty table stays empty; other columns are left out.
    """
    docs = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_n"), F.col(source).alias("_s"))
    sums = cut(docs.groupBy("_s").agg(F.sum("_n").alias("source_size"), F.count("*").alias("_rows")))
    most = sums.agg(F.coalesce(F.max("_rows"), F.lit(0))).first()[0]
    goal = targets(sums.drop("_rows"), "_s").join(sums.select(F.col("_s").alias("_t"), "_rows"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ratio = F.when(F.abs(ratio - F.round(ratio)) < TINY, F.round(ratio)).otherwise(ratio)
    goal = goal.withColumns({"_whole": F.floor(ratio), "_p": ratio - F.floor(ratio), "_g": F.xxhash64(F.col("_s").isNull(), "_s")}).withColumnRenamed("_s", "_t")
    todo = docs.join(goal, F.col("_s").eqNullSafe(F.col("_t"))).drop("_s", "_t").withColumn("_h", F.xxhash64("_k", "_n"))
    per, flown = ROWS, []
    while True:
        part = F.pmod(F.xxhash64("_h", F.lit(per)), F.ceil(F.col("_rows") / per))
        blocks = todo.withColumn("_block", F.xxhash64("_g", part)).repartition("_block").sortWithinPartitions("_block", "_h", "_n", "_k")
        flew = cut(blocks.mapInArrow(_fly(per >= most), blocks.schema).drop("_block"))
        if per >= most:
            break
        open_ = (F.col("_p") > TINY) & (F.col("_p") < 1 - TINY)
        flown.append(flew.filter(~open_))
        todo, per = flew.filter(open_), per * FAN
    for more in flown:
        flew = flew.unionByName(more)
    return flew.select(F.col("_k").alias(key), F.col("_n").alias(size), "source_size", "target", (F.col("_whole") + F.round("_p")).cast("bigint").alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` as often as the mix of its sources takes it; all columns stay, whatever their names.

    Nulls, ties, repeated rows and empty tables are as in ``copies``; a null text has no words and is not taken more
    often than by its chance.
    """
    rid, size, number, turn, copy = fresh(docs, "rid", "size", "copies", "turn", "copy")
    sized = docs.withColumns({size: word_count(text), rid: F.xxhash64(key, text, source)})
    taken = copies(sized, rid, size, source).filter("copies > 0").select(F.col(rid), F.col("copies").alias(number))
    # rows that are alike in all of this are as many on both sides, and take turns
    taken = taken.withColumn(turn, F.row_number().over(Window.partitionBy(rid).orderBy(F.desc(number))))
    rows = sized.withColumn(turn, F.row_number().over(Window.partitionBy(rid).orderBy(size)))
    return rows.join(taken, [rid, turn]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number)))).select(*docs.columns)


def word_count(text: str) -> Column:
    return F.size(words_of(F.col(text))).cast("bigint")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return copies(docs).withColumn("taken", F.col("copies") * F.col("size")).drop("copies")


QUERIES = {"op6_source_mixing": op6_source_mixing}
ORACLE_SQL: dict[str, str] = {}

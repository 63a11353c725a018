"""Window operators. Those without a key run in two steps, so that no task sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.shared import stored


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in range partitions, numbered by ``_part`` in the order of the ranges.

    They are written out: all uses of them see the same boundaries, which come from a sample of the rows.
    """
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[str], into: str) -> DataFrame:
    """Numbers rows from 0 in ``order``: inside range partitions, after the sizes of those before."""
    parts = ranged(df, order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "_part").withColumn(into, (inside + F.col("_before")).cast("int")).drop("_part", "_before")


def cumulative_sum(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), into: str = "cumsum") -> DataFrame:
    """Running sum in ``order``. Without groups, sums of range partitions are added up first: rows sort in parallel."""
    upto = lambda w: F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if by:
        return df.withColumn(into, upto(Window.partitionBy(*by)))
    cut = ranged(df, order)
    sums = cut.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row for each partition
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    return cut.join(before, "_part").withColumn(into, upto(Window.partitionBy("_part")) + F.col("_before")).drop("_part", "_before")


def nearby(parts: DataFrame, value: str, by: Sequence[str], order: Sequence[str], into: str, ahead: bool = False) -> DataFrame:
    """The last value that isn't null at or before a row of its group, or with ``ahead`` the first at or after it.

    ``parts`` comes from ``ranged`` over ``by`` and ``order``: a group may lie in many of them, so none is ever one
    task. A part takes over from the one next to it what that has, or has taken over, for the group they share.
    """
    key, at = F.struct(*by), F.struct(*order)
    some, edge = (F.min_by, F.min) if ahead else (F.max_by, F.max)
    side = Window.orderBy(F.desc("_part") if ahead else "_part")  # over one row for each part
    ends = parts.groupBy("_part").agg(edge(key).alias("_key"))
    of = parts.join(F.broadcast(ends), (parts["_part"] == ends["_part"]) & key.eqNullSafe(F.col("_key"))).drop(ends["_part"])
    ends = of.groupBy("_part", "_key").agg(some(value, F.when(F.col(value).isNotNull(), at)).alias("_v"))
    kept = F.last("_v", ignorenulls=True).over(Window.partitionBy("_key").orderBy(F.desc("_part") if ahead else "_part").rowsBetween(Window.unboundedPreceding, 0))
    taken = ends.select("_part", F.struct(F.col("_key").alias("k"), kept.alias("v")).alias("_end"))
    taken = taken.select(F.col("_part").alias("_p"), F.lag("_end").over(side).alias("_over"))
    w = Window.partitionBy("_part", *by).orderBy(*order)
    inside = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if ahead else F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.join(F.broadcast(taken), parts["_part"] == taken["_p"])
    return joined.withColumn(into, F.coalesce(inside, F.when(key.eqNullSafe(F.col("_over.k")), F.col("_over.v")))).drop("_p", "_over")


def rolling_mean(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], width: int, into: str) -> DataFrame:
    """Mean of the last ``width`` rows; null until there are so many values."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return df.withColumn(into, F.when(F.count(value).over(w) == width, F.avg(value).over(w)))


def rate(df: DataFrame, value: str, time: str, by: Sequence[str], into: str) -> DataFrame:
    """Change of value by change of time since the row before; null where there is none or no time has passed."""
    w = Window.partitionBy(*by).orderBy(time)
    dt = F.col(time) - F.lag(time).over(w)
    return df.withColumn(into, F.when(dt != 0, (F.col(value) - F.lag(value).over(w)) / dt))


def intervals(df: DataFrame, time: str, by: Sequence[str], into: str = "stop") -> DataFrame:
    """Adds the time of the next row of the group."""
    return df.withColumn(into, F.lead(time).over(Window.partitionBy(*by).orderBy(time)))


def dense_by_first(df: DataFrame, key: str, position: str, into: str) -> DataFrame:
    """Numbers keys from 0 by their first position."""
    first = df.groupBy(key).agg(F.min(position).alias("_first"))
    return df.join(numbered(first, ["_first", key], into).drop("_first"), key)


def fill_forward(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], into: str, bounded: bool = True) -> DataFrame:
    """The last value that isn't null; ``bounded`` leaves null what comes after the group's last value."""
    w = Window.partitionBy(*by).orderBy(*order)
    last: Column = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if bounded:
        last = F.when(F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).isNotNull(), last)
    return df.withColumn(into, last)


def overlapping(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], depth: int, into: str) -> DataFrame:
    """Array of the values from ``depth`` rows before to ``depth`` after, mirrored at the ends of the group."""
    w = Window.partitionBy(*by).orderBy(*order)
    around = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    backward = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [F.array(*(F.nth_value(value, k).over(side) for k in range(1, depth + 1))) for side in (around, backward)]
    before = F.row_number().over(w) - 1
    after = F.count("*").over(around) - 1 - before
    back = [F.when(before >= k, F.lag(value, k).over(w)).otherwise(F.get(ends[0], (F.lit(k - 1) - before).cast("int"))) for k in range(depth, 0, -1)]
    ahead = [F.when(after >= k, F.lead(value, k).over(w)).otherwise(F.get(ends[1], (F.lit(k - 1) - after).cast("int"))) for k in range(1, depth + 1)]
    return df.withColumn(into, F.array(*back, F.col(value), *ahead))

"""Intervals and step functions over time, by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.windows import ranged


def active(df: DataFrame, start: str, stop: str, by: Sequence[str]) -> DataFrame:
    """Union of the half-open intervals of each group, as maximal intervals ``start stop``, and how many were most at once.

    A sweep: +1 at each start, -1 at each stop, a running sum; equal times are added up before, so that touching
    intervals join.
    """
    keys = list(by)
    ends = df.where(F.col(start) < F.col(stop)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("t")
    steps = steps.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumns({"t1": F.lead("t").over(w), "new": F.when(F.lag("n", 1, 0).over(w) == 0, 1).otherwise(0)}).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = steps.where("n > 0").groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("t1").alias("stop"), F.max("n").alias("most"))
    return runs.drop("run")


def step_integral(steps: DataFrame, time: str, value: str, by: Sequence[str], until: str | None = None) -> DataFrame:
    """Sum of value times duration, each value holding until the next row of its group (the last until ``until``)."""
    w = Window.partitionBy(*by).orderBy(time)
    end = F.lead(time).over(w)
    if until:
        end = F.coalesce(end, F.col(until))
    return steps.withColumn("_dt", end - F.col(time)).groupBy(*by).agg(F.coalesce(F.sum(F.col(value) * F.col("_dt")), F.lit(0.0)).alias("integral"))


def allocate(df: DataFrame, start: str, stop: str, width: float, by: Sequence[str]) -> DataFrame:
    """Seconds of each group's intervals that fall in each bin of the given width: ``bin`` (its number) and ``busy``."""
    lo, hi = F.floor(F.col(start) / width), F.ceil(F.col(stop) / width) - 1
    cells = df.where(F.col(start) < F.col(stop)).withColumn("bin", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    part = F.least(F.col(stop), (F.col("bin") + 1) * width) - F.greatest(F.col(start), F.col("bin") * width)
    return cells.groupBy(*by, "bin").agg(F.sum(part).alias("busy"))


def align(samples: DataFrame, series: str, time: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row for each time, a column for each series: the last sample, but nothing after a series has ended.

    Of samples of a series at one time the highest counts. Times are dealt to ranges; what a range takes over from those
    before it, and whether a series goes on after it, comes from a summary of one row a range.
    """
    parts = ranged(samples.groupBy(time).pivot(series, list(names)).agg(F.max(value)), [time])
    each = parts.groupBy("_part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(f"_{c}") for c in names))
    before, after = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    carried = each.select("_part", *(F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_b_{c}") for c in names), *(F.first(f"_{c}", ignorenulls=True).over(after).isNotNull().alias(f"_a_{c}") for c in names))
    w = Window.partitionBy("_part").orderBy(time)
    goes_on = lambda c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).isNotNull() | F.col(f"_a_{c}")
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_b_{c}"))
    return parts.join(F.broadcast(carried), "_part").select(time, *(F.when(goes_on(c), last(c)).alias(c) for c in names))

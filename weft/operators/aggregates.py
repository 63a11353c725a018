"""Aggregations that take more than one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """``bin`` and ``n`` of equal bins from the least to the highest value, which belongs to the last one."""
    edge = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = F.col(column)
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return df.where(x.isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # edge is one row


def share_of_total(df: DataFrame, by: Sequence[str], value: Column, least: float = 0.0) -> DataFrame:
    """Sum of each group and its share of all; groups with less than the given share are left out."""
    sums = df.groupBy(*by).agg(F.sum(value).alias("total"))
    every = sums.agg(F.sum("total").alias("_all"))
    return sums.crossJoin(F.broadcast(every)).withColumn("share", F.col("total") / F.col("_all")).drop("_all").where(F.col("share") >= least)


def ewma(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.5, into: str = "ewma") -> DataFrame:
    """The first value, then alpha * new + (1 - alpha) * old, of each group in ``order``.

    A value's weight is alpha * (1 - alpha)**(number of later ones), the first one's (1 - alpha)**(all others): the
    fold becomes a sum, so a group needs one window that counts and one aggregation.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    every = Window.partitionBy(*by)
    later = F.count("*").over(every) - F.row_number().over(w)
    weight = F.pow(F.lit(1 - alpha), later) * F.when(F.row_number().over(w) == 1, 1.0).otherwise(alpha)
    return df.withColumn("_w", weight).groupBy(*by).agg(F.sum(F.col(value) * F.col("_w")).alias(into))


def decayed_counts(df: DataFrame, item: str, time: str, now: float | Column, spans: Sequence[float] = (5, 60, 3600)) -> DataFrame:
    """For each item how often it came, an event of age t counting exp(-t / span), for each span in seconds."""
    age = (now if isinstance(now, Column) else F.lit(float(now))) - F.col(time)
    return df.groupBy(item).agg(*(F.sum(F.exp(-age / s)).alias(f"last_{s:g}") for s in spans))


def running(df: DataFrame, by: Sequence[str], start: Column, stop: Column, action: str) -> DataFrame:
    """Of each group first start, last stop, and the duration of each action in whole microseconds, never negative."""
    micros = F.greatest(F.floor((stop - start) * 1_000_000), F.lit(0)).cast("bigint")
    return df.groupBy(*by, action).agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.sum(micros).alias("micros"))


def sum_mappings(df: DataFrame, column: str) -> DataFrame:
    """Key-wise sums of a column of maps."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))


def collect_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """The values of each group in order, as an array; for groups that are known to be small."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda p: p["_v"]).alias(into))

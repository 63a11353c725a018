"""Projections, filters, sorting, sets and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.windows import numbered

#: Longer lists of values become a join.
LONG_LIST = 1000


def assign(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def isin(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    values = [v for v in values if v is not None]
    if len(values) <= LONG_LIST:
        return df.where(F.col(column).isin(*values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], [column])
    return df.join(wanted, column, "left_semi").select(*df.columns)


def date_slice(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows from the start of the first day to the end of the last."""
    end = date.fromisoformat(last) + timedelta(days=1)
    return df.where((F.col(column) >= F.lit(first).cast("timestamp_ntz")) & (F.col(column) < F.lit(end.isoformat()).cast("timestamp_ntz")))


def categorize(df: DataFrame, column: str, into: str) -> DataFrame:
    """Adds the code of each value: its place among the distinct values in order, -1 for null."""
    codes = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], into)
    return df.join(codes, column, "left").withColumn(into, F.coalesce(into, F.lit(-1))).select(*df.columns, into)


def size(df: DataFrame) -> int:
    return df.count() * len(df.columns)


def drop_duplicates(df: DataFrame, subset: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """The first or last row of each key in ``order``, by one aggregation with map-side combine.

    Null keys are alike. ``order`` has to tell rows apart.
    """
    rest = [c for c in df.columns if c not in subset]
    best = {"first": F.min_by, "last": F.max_by}[keep]
    picked = df.groupBy(*subset).agg(best(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*(F.col(c) if c in subset else F.col(f"_row.{c}").alias(c) for c in df.columns))


def merge_sorted(frames: Sequence[DataFrame], *order: str | Column) -> DataFrame:
    """K inputs that are sorted alike, as one sorted output."""
    return reduce(DataFrame.unionByName, frames).orderBy(*order)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns that some frames lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_k(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def head(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first ``k`` rows in the given order."""
    return df.orderBy(*order).limit(k)


def tail(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The last ``k`` rows in the given order, in that order."""
    last = df.orderBy(*(F.desc(c) for c in order)).limit(k)
    return last.orderBy(*order)


def after(df: DataFrame, sequence: str, start: int, count: int | None = None) -> DataFrame:
    """Rows from a sequence number on; at most ``count``, in order."""
    rows = df.where(F.col(sequence) >= start)
    return rows if count is None else rows.orderBy(sequence).limit(count)

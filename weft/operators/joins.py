"""Joins with pandas-like column rules or SQL ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import user
from weft.operators.windows import nearby, ranged


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on: Sequence[str] | None = None, left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y"), indicator: str | None = None, null_equal: bool = False, partitions: int | None = None) -> DataFrame:
    """Equi-join.

    Without keys, on all common columns. Keys given by ``on`` appear once, those of ``left_on`` and ``right_on`` both.
    Other columns with a common name get the suffixes. ``null_equal`` lets null keys match, as pandas does.
    ``indicator`` names a column that says where a row is from. ``how``: inner, left, right, outer.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join: {how}")
    if on is None and left_on is None:
        on = [c for c in left.columns if c in right.columns]
        if not on:
            raise ValueError("no common columns to merge on")
    lk, rk = list(on or left_on or ()), list(on or right_on or ())
    if len(lk) != len(rk) or not lk:
        raise ValueError("keys of both sides have to be as many")
    shared = bool(on)
    lname, rname = {c: f"_l{i}" for i, c in enumerate(left.columns)}, {c: f"_r{i}" for i, c in enumerate(right.columns)}
    a = left.select(*(F.col(f"`{c}`").alias(n) for c, n in lname.items()), F.lit(True).alias("_in_l"))
    b = right.select(*(F.col(f"`{c}`").alias(n) for c, n in rname.items()), F.lit(True).alias("_in_r"))
    equal = (lambda x, y: x.eqNullSafe(y)) if null_equal else (lambda x, y: x == y)
    df = a.join(b, reduce(lambda x, y: x & y, (equal(F.col(lname[x]), F.col(rname[y])) for x, y in zip(lk, rk, strict=True))), "full" if how == "outer" else how)
    out: list[Column] = []
    for c, n in lname.items():
        if shared and c in lk:
            out.append(F.coalesce(n, rname[c]).alias(c))
        else:
            out.append(F.col(n).alias(c + suffixes[0] if c in right.columns else c))
    for c, n in rname.items():
        if not (shared and c in rk):
            out.append(F.col(n).alias(c + suffixes[1] if c in left.columns else c))
    if indicator:
        out.append(F.when(F.col("_in_l").isNull(), "right_only").when(F.col("_in_r").isNull(), "left_only").otherwise("both").alias(indicator))
    df = df.select(*out)
    return df.repartition(partitions, *lk) if partitions else df


def join_on_index(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], index: str, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join where one side's key is its index, or both sides' are; ``index`` names the key of the result.

    The key appears once. A frame's index is a column that its caller names; keys may be several columns, some of them
    index levels.
    """
    key = [index] if len(left_on) == 1 else [f"{index}_{k}" for k in range(len(left_on))]
    a = left.withColumnsRenamed(dict(zip(left_on, key, strict=True)))
    b = right.withColumnsRenamed(dict(zip(right_on, key, strict=True)))
    return merge(a, b, how, on=key, suffixes=suffixes)


def join(left: DataFrame, others: Sequence[DataFrame], index: str, how: str = "left") -> DataFrame:
    """One frame with others, all on their index; other columns may not have a name in common."""
    names = [c for df in (left, *others) for c in df.columns if c != index]
    if len(names) != len(set(names)):
        raise ValueError("columns overlap")
    return reduce(lambda a, b: merge(a, b, how, on=[index]), others, left)


def cogroup(left: DataFrame, right: DataFrame, on: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """``function(rows of left, rows of right)`` for each key of either side; a key's rows have to fit in a task.

    A call costs some milliseconds, whatever the number of rows: many small groups are for ``cogroups``.
    """
    return user.dealt(left, on).groupBy(*on).cogroup(user.dealt(right, on).groupBy(*on)).applyInPandas(function, schema)


def cogroups(left: DataFrame, right: DataFrame, on: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """As ``cogroup``, but the function gets all rows of many keys at once: two Arrow tables, sorted by the keys."""
    keys = list(on)
    rest = [[c for c in df.columns if c not in keys] for df in (left, right)]
    packed = [F.struct(*(cols or [F.lit(0).alias("_")])) for cols in rest]
    a = left.select(*keys, F.lit(0).alias("_side"), packed[0].alias("_rows0"), F.lit(None).alias("_rows1"))
    b = right.select(*keys, F.lit(1).alias("_side"), F.lit(None).alias("_rows0"), packed[1].alias("_rows1"))

    def both(part: pa.Table) -> pa.Table:
        sides = []
        for k, cols in enumerate(rest):
            own = part.filter(pc.equal(part["_side"], k))
            sides.append(pa.table([own[c] for c in keys] + [pc.struct_field(own[f"_rows{k}"], c) for c in cols], names=[*keys, *cols]))
        return function(*sides)

    return user.by_groups(a.unionByName(b), keys, both, schema)


def semi(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], default: dict | None = None, split: bool = False) -> DataFrame:
    """For each left row the values of the last right row of its group that is not later.

    Both sides run through one window over their union, right rows first where times are equal; of right rows of equal
    time any one counts, so they should be unique. A group is one task's sort, which spills; ``split`` is for
    groups that hold a large share of all rows: it deals them to ranges of time, and writes the rows out once.
    """
    keys = list(by)
    cols = [c for c in left.columns if c not in keys and c != on]
    a = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*(cols or [F.lit(0).alias("_")])).alias("_row"), F.lit(None).alias("_value"))
    b = right.select(*keys, on, F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(*values).alias("_value"))
    if split:
        df = nearby(ranged(a.unionByName(b), [*keys, on, "_side"]), "_value", keys, [on, "_side"], "_value").where("_side = 1")
    else:
        seen = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        df = a.unionByName(b).withColumn("_value", F.last("_value", ignorenulls=True).over(seen)).where("_side = 1")
    return df.select(*keys, on, *(F.col(f"_row.{c}").alias(c) for c in cols), *(F.coalesce(F.col(f"_value.{v}"), F.lit((default or {}).get(v))).alias(v) for v in values))


def nearest(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], value: str, into: str, split: bool = False) -> DataFrame:
    """For each left row the value of the right row of its group whose ``on`` (a number) is nearest; ties go to the earlier.

    ``split`` is as in ``asof``.
    """
    keys = list(by)
    cols = [c for c in left.columns if c not in keys and c != on]
    a = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*(cols or [F.lit(0).alias("_")])).alias("_row"), F.lit(None).alias("_at"))
    b = right.select(*keys, on, F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(F.col(on).alias("t"), F.col(value).alias("v")).alias("_at"))
    w = Window.partitionBy(*keys).orderBy(on, "_side")
    if split:
        df = ranged(a.unionByName(b), [*keys, on, "_side"])
        df = nearby(nearby(df, "_at", keys, [on, "_side"], "_before"), "_at", keys, [on, "_side"], "_after", ahead=True).where("_side = 1")
    else:
        df = a.unionByName(b).withColumns({"_before": F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first("_at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("_side = 1")
    back, ahead = F.col(on) - F.col("_before.t"), F.col("_after.t") - F.col(on)
    pick = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before.v")).otherwise(F.col("_after.v"))
    return df.select(*keys, on, *(F.col(f"_row.{c}").alias(c) for c in cols), pick.alias(into))


def overlap(left: DataFrame, right: DataFrame, start: str, stop: str, bucket: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose half-open intervals [start, stop) overlap; the right side's columns get the suffix ``_r``.

    Intervals are cut into buckets of the given length and joined on equal buckets; a pair counts in the bucket where
    its overlap begins. So no row meets all others, unless intervals are long against the bucket.
    """
    cells = lambda df: df.where(F.col(start) < F.col(stop)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.greatest(F.floor(F.col(start) / bucket), F.ceil(F.col(stop) / bucket) - 1))))
    a = cells(left)
    b = cells(right).select(*(F.col(c).alias(f"{c}_r") for c in right.columns), F.col("_b").alias("_br"))
    on = F.col("_b") == F.col("_br")
    for c in by:
        on &= F.col(c) == F.col(f"{c}_r")
    on &= (F.col(start) < F.col(f"{stop}_r")) & (F.col(f"{start}_r") < F.col(stop))
    on &= F.floor(F.greatest(F.col(start), F.col(f"{start}_r")) / bucket) == F.col("_b")
    return a.join(b, on).drop("_b", "_br")

"""User functions: scalar, by partition, by group, coroutines, and ones that make rows."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar(function: Callable, returns: str | T.DataType, pure: bool = True):
    """A row-wise Python function as an Arrow-batched column function. What isn't pure isn't run twice or moved."""
    made = F.udf(function, returns, useArrow=True)
    return made if pure else made.asNondeterministic()


def vector(function: Callable[[pd.Series], pd.Series], returns: str | T.DataType):
    """A function of whole columns, batch by batch: the form for what pandas or numpy can do at once."""
    return F.pandas_udf(function, returns)


def by_partition(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(function, frames)

    return df.mapInPandas(run, schema)


def by_group(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Keys are column names; each group has to fit in a task.

    A call costs about a millisecond, whatever the group's size: many small groups are for ``by_groups``.
    """
    return dealt(df, keys).groupBy(*keys).applyInPandas(function, schema)


def by_groups(df: DataFrame, keys: Sequence[str], function: Callable[[pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """As ``by_group``, but the function gets many whole groups at once, one after another: Arrow tables sorted by the keys."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches, names):
            yield from function(part).to_batches()

    return dealt(df, names).sortWithinPartitions(*names).mapInArrow(run, schema)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a key in one task. The number of tasks is fixed: what Python does takes time by rows and groups, and a few bytes of each are no reason to put them all in one task."""
    if not all(isinstance(k, str) for k in keys):
        raise TypeError("groups are given by column names")
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _whole(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows cut only where a group ends."""
    kept: list[pa.RecordBatch] = []  # begin of the last group
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _last_group(batch, keys)
        if kept and (at or _last_group(pa.Table.from_batches([kept[-1].slice(kept[-1].num_rows - 1), batch.slice(0, 1)]), keys)):
            # the kept group ends in this batch, or has ended before it
            yield pa.Table.from_batches([*kept, batch.slice(0, at)])
            kept = []
        elif at:
            yield pa.Table.from_batches([batch.slice(0, at)])
        kept.append(batch.slice(at))
    if kept:
        yield pa.Table.from_batches(kept)


def _last_group(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> int:
    """Where the last group of sorted rows begins. Nulls are alike, and so are NaNs and zeros of either sign."""
    new = np.zeros(rows.num_rows, bool)
    for key in keys:
        c = rows.column(key)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if pa.types.is_nested(c.type):
            values = c.to_pylist()
            new[1:] |= [a != b for a, b in zip(values, values[1:], strict=False)]
            continue
        if pa.types.is_floating(c.type):
            c = pc.add(c, pa.scalar(0.0, c.type))
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return int(np.flatnonzero(new)[-1]) if new.any() else 0


def concurrently(df: DataFrame, column: str, function: Callable[[object], Awaitable], into: str, returns: str, at_once: int = 64) -> DataFrame:
    """Awaits a coroutine function for every value, so many at once in each task."""
    schema = T.StructType([*df.schema.fields, T.StructField(into, T._parse_datatype_string(returns))])

    async def gather(values: Iterable) -> list:
        gate = asyncio.Semaphore(at_once)

        async def one(value):
            async with gate:
                return await function(value)

        return await asyncio.gather(*map(one, values))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{into: asyncio.run(gather(frame[column].tolist()))})

    return df.mapInPandas(run, schema)


def rows_from(df: DataFrame, function: Callable[[tuple], Iterable[dict]], schema: str | T.StructType) -> DataFrame:
    """Any number of rows for each row, which the function gets as a named tuple."""
    names = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([out for row in frame.itertuples(index=False) for out in function(row)], columns=names)

    return df.mapInPandas(run, schema)

"""Lazy readers, generated frames, and the state dump."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, header: bool = True, **options: str) -> DataFrame:
    """The schema is asked for: without it Spark would read the files twice."""
    return spark.read.options(header=header, **options).schema(schema).csv(paths if isinstance(paths, str) else list(paths))


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row for each line, with the file it is from."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def read_blocks(spark: SparkSession, paths: str, delimiter: str) -> DataFrame:
    """Records that end with ``delimiter``; Spark's readers split files at any byte and find the next delimiter."""
    return spark.read.option("lineSep", delimiter).text(paths).select(F.col("value").alias("record"))


def from_partitions(spark: SparkSession, make: Callable[..., pd.DataFrame], inputs: Sequence, schema: str | T.StructType) -> DataFrame:
    """One partition for each input, made by ``make(input)`` where it runs."""
    shared = list(inputs)

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in frame["id"]:
                yield make(shared[k])

    return spark.range(0, len(shared), 1, max(1, len(shared))).mapInPandas(build, schema)


def time_series(spark: SparkSession, start: datetime, stop: datetime, step_seconds: int, seed: int = 0) -> DataFrame:
    """A demo series with columns ``ts id x y``: one row for each step from ``start``, before ``stop``."""
    n = max(0, -(-int((stop - start).total_seconds()) // step_seconds))
    base = F.lit(start).cast("timestamp_ntz")
    ts = base + F.make_dt_interval(secs=(F.col("id") * step_seconds).cast("decimal(18,6)"))
    return spark.range(n).select(ts.alias("ts"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)).alias("id"), (F.rand(seed) * 2 - 1).alias("x"), (F.rand(seed + 1) * 2 - 1).alias("y"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types. A missing column, or one that can't be cast safely, is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    for f in schema:
        have = df.schema[f.name].dataType
        if have != f.dataType and not isinstance(have, T.NullType) and not (isinstance(have, numeric) and isinstance(f.dataType, numeric)):
            raise TypeError(f"incompatible types for {f.name}: {have.simpleString()} and {f.dataType.simpleString()}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def write_state(df: DataFrame, path: str, exclude: Sequence[str] = ()) -> None:
    """Writes nested state as compressed JSON lines, without the columns in ``exclude``."""
    df.drop(*exclude).write.option("compression", "gzip").mode("errorifexists").json(path)


def read_state(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def from_pandas(spark: SparkSession, frame: pd.DataFrame, partitions: int | None = None, index: str | None = None) -> DataFrame:
    """A frame that the driver holds; ``index`` names a column for its index."""
    df = spark.createDataFrame(frame.rename_axis(index).reset_index() if index else frame)
    return df.repartition(partitions) if partitions else df


def from_dict(spark: SparkSession, columns: dict[str, Sequence], partitions: int | None = None) -> DataFrame:
    """A frame from lists of equal length, by column name."""
    return from_pandas(spark, pd.DataFrame(columns), partitions)


def from_sequence(spark: SparkSession, values: Sequence, kind: str, partitions: int | None = None, name: str = "value") -> DataFrame:
    """One row for each value that the driver holds."""
    df = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return df.repartition(partitions) if partitions else df


def number_range(spark: SparkSession, start: int, stop: int, step: int = 1, partitions: int | None = None) -> DataFrame:
    """Whole numbers from ``start`` on and before ``stop``, made where they are used."""
    return spark.range(start, stop, step, partitions).withColumnRenamed("id", "value")

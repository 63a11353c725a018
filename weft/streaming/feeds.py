"""Feeds over a stream of events: windows, sessions, duplicates, topics, and state by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files_at_once: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, as they come."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Times without zone become instants (UTC), as watermarks need them."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(df: DataFrame, column: str, length: str, late: str, by: list[str], value: str) -> DataFrame:
    return df.withWatermark(column, late).groupBy(F.window(column, length).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, column: str, length: str, slide: str, late: str, by: list[str]) -> DataFrame:
    return df.withWatermark(column, late).groupBy(F.window(column, length, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, column: str, gap: str, late: str, by: list[str]) -> DataFrame:
    return df.withWatermark(column, late).groupBy(F.session_window(column, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")


def once(df: DataFrame, keys: list[str], column: str, late: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark."""
    return df.withWatermark(column, late).dropDuplicatesWithinWatermark(keys)


def topic(df: DataFrame, name: str, column: str) -> DataFrame:
    """Messages of a topic: its name, the time, and the row as JSON."""
    return df.select(F.lit(name).alias("topic"), F.col(column).alias("time"), F.to_json(F.struct(*df.columns)).alias("message"))


def actors(df: DataFrame, key: str, step: Callable[[dict, pd.DataFrame], dict], fields: str) -> DataFrame:
    """State by key: ``step(state, rows)`` returns the new state, which goes out after each batch. ``fields`` are its columns."""
    names = [f.name for f in T._parse_datatype_string(fields).fields]
    kind = df.schema[key].dataType.simpleString()

    def work(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get, strict=True)) if state.exists else {}
        for frame in frames:
            now = step(now, frame)
        state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([(keys[0], *(now[n] for n in names))], columns=[key, *names])

    return df.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, {fields}", fields, "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs over all there is and ends; the rows are in tables under ``folder``, which all machines share.

    A batch that is run again replaces its own table; a later call with the same folder goes on where the last one
    ended. In mode complete the last batch counts, else all do.
    """
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    last = [-1]

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        last[0] = max(last[0], number)

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/rows")
    return (out.where(F.col("batch") == last[0]) if mode == "complete" else out).drop("batch")


def every_batch(df: DataFrame, function: Callable[[DataFrame, int], None], interval: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Calls ``function(rows, number)`` for every micro-batch, at an interval or for all there is."""
    writer = df.writeStream.foreachBatch(function)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()

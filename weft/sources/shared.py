"""A folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that ``spark.checkpoint.dir`` names, which all executors share.

    It goes when the application ends. Only in local mode, as in tests, a session that names none gets a local one.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = tempfile.gettempdir()
    top = f"{top}/weft-{spark.sparkContext.applicationId}"
    _files(spark, top)[1].deleteOnExit(_files(spark, top)[0])
    return top


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder: computed once, however often it is used after."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder that nothing reads any more."""
    where, files = _files(spark, path)
    files.delete(where, True)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())

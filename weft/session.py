"""Session with the settings that the package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "weft", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name, with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

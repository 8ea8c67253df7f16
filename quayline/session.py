"""A SparkSession with the settings that all results here assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quayline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI mode, adaptive execution. Sizes of shuffles and partitions are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()

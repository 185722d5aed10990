"""The session this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "skein", **conf: str) -> SparkSession:
    """UTC, adaptive execution, dynamic partition overwrite and Arrow; ``conf`` adds or replaces settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Folders for tables and trees that a query makes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder name below the session's checkpoint folder; below a temporary one only on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="skein-")
    return f"{base.removeprefix('file://').removeprefix('file:').rstrip('/')}/scratch/{uuid.uuid4().hex}"

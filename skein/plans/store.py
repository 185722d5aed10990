"""Chunks on disk, partitioned by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def replace(chunks: DataFrame, path: str, on_empty: str = "keep", repo: str | None = None) -> int:
    """Replace the partitions of the repositories in ``chunks`` and leave all others; the number of rows written.

    ``chunks`` is computed once: the rows are counted while they are written.
    Nothing to write keeps the old rows, or clears those of ``repo`` with ``on_empty="clear"``.
    """
    if on_empty not in ("keep", "clear"):
        raise ValueError("on_empty is keep or clear")
    spark = chunks.sparkSession
    written = Observation()
    rows = chunks.observe(written, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_name").parquet(path)
    total = int(written.get["rows"])
    if not total and on_empty == "clear" and repo is not None:
        drop(spark, path, repo)
    return total


def drop(spark: SparkSession, path: str, repo: str) -> None:
    """Delete a repository's partition."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/repo_name={repo}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

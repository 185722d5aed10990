"""Statistics of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def chunk_types(chunks: DataFrame) -> DataFrame:
    """(repo_name, chunk_type, count), most frequent first."""
    return chunks.groupBy("repo_name", "chunk_type").agg(F.count(F.lit(1)).alias("count")).orderBy("repo_name", F.desc("count"), "chunk_type")


def extensions(files: DataFrame, top: int = 8) -> DataFrame:
    """(extension, count) of the most frequent extensions of paths with a dot."""
    ext = paths.extension(F.col("file_path")).alias("ext")
    counted = files.filter(F.instr("file_path", ".") > 0).groupBy(ext).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(paths.extension_label(F.col("ext")).alias("extension"), "count").orderBy(F.desc("count"), "extension").limit(top)


def type_shares(counts: DataFrame, repos: DataFrame) -> DataFrame:
    """Chunk counts with their percentage of the repository's total; 0 where the total is 0."""
    totals = repos.select(F.col("name").alias("repo_name"), "total_chunks")
    share = F.when(F.col("total_chunks") > 0, F.round(F.col("count") * 100.0 / F.col("total_chunks"), 4)).otherwise(F.lit(0.0))
    return counts.join(totals, "repo_name").withColumn("percent", share)


def repo_totals(repos: DataFrame) -> DataFrame:
    """Totals over all repositories: chunks, indexed ones, remote ones."""
    return repos.agg(F.sum("total_chunks").cast("long").alias("total_chunks"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("type") != "local").alias("remote"))


def progress(chunks: DataFrame, batch: int = 20) -> DataFrame:
    """(repo_name, files, chunks, batches): what an indexing run counts, and how many calls embed it."""
    n = F.count(F.lit(1))
    return chunks.groupBy("repo_name").agg(F.count_distinct("doc_id").alias("files"), n.alias("chunks"), F.ceil(n / batch).alias("batches"))

"""Indexing a tree: scan, chunk, embed, replace, and the repository's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IndexSettings
from ..operators import embed, syntax
from ..sources import tree
from . import store

STATES = "repo_name string, status string, total_chunks int, error_message string"


def scan(spark: SparkSession, path: str, repo: str, settings: IndexSettings = IndexSettings()) -> DataFrame:
    tree.register(spark)
    return spark.read.format("repo_tree").option("repo", repo).option("excludes", "\n".join(settings.excludes)).option("max_kb", settings.max_file_kb).load(path)


def index_repo(spark: SparkSession, path: str, repo: str, out: str, make_client: Callable = embed.hashing_client, settings: IndexSettings = IndexSettings(), on_empty: str = "keep") -> DataFrame:
    """Index one tree and return its state transitions; a failure keeps the former chunks and ends in ``error``."""
    states = [(repo, "indexing", None, None)]
    try:
        chunks = syntax.chunk_files(scan(spark, path, repo, settings), settings.chunk_size, settings.overlap)
        rows = embed.with_embeddings(chunks.withColumnRenamed("chunk", "content"), make_client)
        total = store.replace(rows.withColumn("indexed_at", F.current_timestamp()), out, on_empty, repo)
        states.append((repo, "indexed", total, None))
    except Exception as error:  # noqa: BLE001  the state carries it
        states.append((repo, "error", None, str(error)[:500]))
    return spark.createDataFrame(states, STATES)

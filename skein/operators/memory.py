"""Memories of users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def listing(memories: DataFrame, user_id: str = "default", limit: int = 20) -> DataFrame:
    """A user's memories, in order of id so that the cut is stable."""
    return memories.filter(F.col("user_id") == user_id).orderBy("memory_id").limit(limit)


def search(memories: DataFrame, query: Sequence[float] | None, user_id: str = "default", k: int = 10) -> DataFrame:
    """The memories of a user that are nearest to a vector, ranked before the score is rounded; no vector finds none."""
    own = memories.filter(F.col("user_id") == user_id)
    sim = F.lit(None).cast("double") if query is None else vectors.cosine_to(F.col("embedding"), query)
    best = own.withColumn("_similarity", sim).orderBy(F.desc_nulls_last("_similarity"), "memory_id").limit(k if query is not None else 0)
    return best.withColumn("score", F.round("_similarity", 4)).drop("embedding", "_similarity")


def add(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """New memories as they are; a missing user is the default one."""
    return memories.unionByName(rows.withColumn("user_id", F.coalesce("user_id", F.lit("default"))), allowMissingColumns=True)


def remove(memories: DataFrame, memory_id: str) -> DataFrame:
    return memories.filter(F.col("memory_id") != memory_id)


def metadata_kind(value: Column) -> Column:
    """How a metadata value is taken: null is an empty object, an object is kept, all else is an error."""
    parsed = F.try_parse_json(value)
    return F.when(value.isNull(), "empty").when(F.schema_of_variant(parsed).startswith("OBJECT"), "object").otherwise("error")


def normalize_metadata(value: Column) -> Column:
    """A JSON object as it is, ``{}`` for null, null for an error."""
    kind = metadata_kind(value)
    return F.when(kind == "empty", "{}").when(kind == "object", value)

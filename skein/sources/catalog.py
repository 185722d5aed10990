"""Listings of hosted repositories, saved as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a listing, whichever host it is of.
COLUMNS = ("id", "name", "full_name", "description", "url", "clone_url", "default_branch", "private", "language", "stars", "fork")


def github(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``COLUMNS``; missing stars and fork flags are 0 and false; newest first."""
    raw = spark.read.json(path, schema="id long, name string, full_name string, description string, html_url string, clone_url string, default_branch string, private boolean, language string, stargazers_count int, fork boolean, updated_at string")
    out = raw.select(
        "id", "name", "full_name", "description", F.col("html_url").alias("url"), "clone_url", F.coalesce("default_branch", F.lit("main")).alias("default_branch"),
        F.coalesce("private", F.lit(False)).alias("private"), "language", F.coalesce("stargazers_count", F.lit(0)).alias("stars"), F.coalesce("fork", F.lit(False)).alias("fork"), "updated_at",
    )
    return out.orderBy(F.desc_nulls_last("updated_at"), "id").select(*COLUMNS)


def gitlab(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``COLUMNS``; empty names fall through, missing visibility is private, a fork names its origin."""
    raw = spark.read.json(path, schema="id long, name string, path_with_namespace string, name_with_namespace string, description string, web_url string, http_url_to_repo string, default_branch string, visibility string, star_count int, forked_from_project string, last_activity_at string")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    out = raw.select(
        "id", "name", F.coalesce(some("path_with_namespace"), some("name_with_namespace"), some("name"), F.lit("")).alias("full_name"), "description", F.col("web_url").alias("url"),
        F.col("http_url_to_repo").alias("clone_url"), F.coalesce(some("default_branch"), F.lit("main")).alias("default_branch"), (F.coalesce("visibility", F.lit("private")) != "public").alias("private"),
        F.lit(None).cast("string").alias("language"), F.coalesce("star_count", F.lit(0)).alias("stars"), some("forked_from_project").isNotNull().alias("fork"), "last_activity_at",
    )
    return out.orderBy(F.desc_nulls_last("last_activity_at"), "id").select(*COLUMNS)

"""The catalogue of repositories and remote listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


#: Columns that the configuration decides.
CONFIGURED = ("type", "url", "path", "branch", "language", "config")


def upsert(current: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured rows win for type, url, path, branch and language; state stays; new ones are pending; nothing is deleted.

    Columns that only ``current`` has (the state, the last indexing, its error) stay as they are.
    """
    c, n = current.alias("c"), configured.alias("n")
    both = c.join(n, F.col("c.name") == F.col("n.name"), "full_outer")
    given = F.col("n.name").isNotNull()

    def column(name: str) -> Column:
        if name in CONFIGURED and name in configured.columns:
            old = F.col(f"c.{name}") if name in current.columns else F.lit(None)
            return F.when(given, F.col(f"n.{name}")).otherwise(old)
        first = {"status": F.lit("pending"), "total_chunks": F.lit(0)}.get(name)
        return F.col(f"c.{name}") if first is None else F.coalesce(f"c.{name}", first)

    names = [x for x in (*current.columns, *(x for x in configured.columns if x not in current.columns)) if x not in ("name", "total_chunks")]
    return both.select(F.coalesce("n.name", "c.name").alias("name"), *[column(x).alias(x) for x in names], column("total_chunks").cast("long").alias("total_chunks"))


def delete(rows: DataFrame, names: DataFrame, key: str = "repo_name") -> DataFrame:
    """The rows of no deleted repository."""
    return rows.join(names.select(F.col("name").alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def orphans(chunks: DataFrame, repos: DataFrame) -> DataFrame:
    """Chunks whose repository is not in the catalogue."""
    return delete(chunks, repos)


def upsert_chunks(current: DataFrame, changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Changes replace content of equal keys but keep the chunk type; others are added."""
    old, new = current.alias("o"), changes.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    present = F.col("n._new").isNotNull()
    return both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], F.coalesce("o.chunk_type", "n.chunk_type").alias("chunk_type"), F.when(present, F.col("n.chunk")).otherwise(F.col("o.chunk")).alias("chunk"))


def pending_repos(repos: DataFrame, configured: DataFrame) -> DataFrame:
    """Pending repositories that are configured."""
    return repos.filter(F.col("status") == "pending").join(configured.select("name"), "name")


def local_path(kind: Column, path: Column, name: Column, cache: str = "/cache") -> Column:
    """Where a repository lies: its own path or a folder of its name."""
    return F.when(kind == "local", F.coalesce(F.nullif(path, F.lit("")), F.concat(F.lit("/repos/"), name))).otherwise(F.concat(F.lit(f"{cache}/"), name))


def map_remote(rows: DataFrame) -> DataFrame:
    """Defaults of a remote listing: private unless public, main branch, slug of the full name."""
    return rows.select(
        "id", "full_name", text.slug(F.col("full_name")).alias("slug"),
        (F.coalesce("visibility", F.lit("private")) != "public").alias("private"), F.lit("main").alias("default_branch"),
    )


def search_remote(rows: DataFrame, words: str, limit: int = 30) -> DataFrame:
    """Rows whose full name has the words; blank words match all."""
    needle = words.strip().lower()
    found = rows.filter(F.contains(F.lower("full_name"), F.lit(needle))) if needle else rows
    return found.orderBy("full_name", "id").limit(limit)


def not_configured(remote: DataFrame, repos: DataFrame, first_slash: bool = False) -> DataFrame:
    """Remote rows whose slug is no configured name; the slug replaces every slash or only the first."""
    name = (text.first_slash_slug if first_slash else text.slug)(F.col("full_name"))
    return remote.withColumn("_slug", name).join(repos.select(F.col("name").alias("_name")), F.col("_slug") == F.col("_name"), "left_anti").drop("_slug")


def rename(configured: DataFrame, old: str, new: str) -> DataFrame:
    """The configuration with one repository under another name; what the catalogue and the chunks hold of the old one is orphaned."""
    return configured.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))


def starred(rows: DataFrame, words: str, limit: int = 30) -> DataFrame:
    """A hosted search: most stars first, each row with the number of all rows found."""
    needle = words.strip().lower()
    found = rows.filter(F.contains(F.lower("full_name"), F.lit(needle))) if needle else rows
    total = found.agg(F.count(F.lit(1)).alias("total_count"))
    return found.orderBy(F.desc("stars"), "id").limit(limit).join(F.broadcast(total))


def active(rows: DataFrame, words: str = "", limit: int = 50) -> DataFrame:
    """A hosted listing by last activity."""
    needle = words.strip().lower()
    found = rows.filter(F.contains(F.lower("full_name"), F.lit(needle))) if needle else rows
    return found.orderBy(F.desc("last_activity_at"), "id").limit(limit)


def project(rows: DataFrame, full_name: str) -> DataFrame:
    """One project by its path, with the path as an address takes it."""
    return rows.filter(F.col("full_name") == full_name).withColumn("encoded", F.url_encode("full_name"))


def flag(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows with ``selected``: whether their key is among the chosen."""
    marks = chosen.select(F.col(key).alias("_chosen")).distinct()
    return rows.join(marks, F.col(key) == F.col("_chosen"), "left").withColumn("selected", F.col("_chosen").isNotNull()).drop("_chosen")


def apply_states(repos: DataFrame, transitions: DataFrame) -> DataFrame:
    """The catalogue after its latest transitions (repo_name, at, seq, status, total_chunks, error_message).

    Only ``indexed`` sets the number of chunks and the time; an error keeps both; every other state clears the message.
    """
    done = F.col("status") == "indexed"
    last = transitions.groupBy(F.col("repo_name").alias("_repo")).agg(
        F.max(F.struct("at", "seq", "status", "error_message")).alias("_s"), F.max(F.when(done, F.struct("at", "seq", "total_chunks"))).alias("_i")
    )
    both = repos.join(last, F.col("name") == F.col("_repo"), "left")
    return both.select(
        "name", F.coalesce("_s.status", "status").alias("status"), F.coalesce("_i.total_chunks", "total_chunks").alias("total_chunks"),
        F.col("_i.at").alias("last_indexed_at"), F.when(F.col("_s.status") == "error", F.col("_s.error_message")).alias("error_message"),
    )


def with_tokens(repos: DataFrame, tokens: DataFrame) -> DataFrame:
    """Repositories of a configuration file take the token of their type where they have none; others keep what they have."""
    given = tokens.select(F.col("type").alias("_type"), F.col("token").alias("_token"))
    return repos.join(given, F.col("type") == F.col("_type"), "left").withColumn("token", F.coalesce(F.nullif("token", F.lit("")), "_token")).drop("_type", "_token")

"""Layered settings and their differences from the defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(layers: DataFrame) -> DataFrame:
    """(key, value): the first layer with a value that is neither null nor empty wins; layers go by rank."""
    found = layers.filter(F.nullif("value", F.lit("")).isNotNull())
    return found.groupBy("key").agg(F.min_by("value", "rank").alias("value"))


def overrides(current: DataFrame, defaults: DataFrame) -> DataFrame:
    """The keys whose value differs from the default, null-safe."""
    both = current.alias("c").join(defaults.alias("d"), "key", "left")
    return both.filter(~F.col("c.value").eqNullSafe(F.col("d.value"))).select("key", F.col("c.value").alias("value"), F.col("d.value").alias("default_value"))


def decode(rows: DataFrame) -> DataFrame:
    """(id, key, value) of settings kept as a JSON object of strings; null and broken ones have none."""
    return rows.select("id", F.explode(F.from_json("settings", "map<string,string>")).alias("key", "value"))


def encode(pairs: DataFrame) -> DataFrame:
    """(id, settings): one JSON object for each id, keys in order."""
    return pairs.groupBy("id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("settings"))


def put(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, settings) after an upsert by id; an empty object falls back to what is in effect, and rows are kept raw, not merged."""
    old, new = stored.alias("o"), changes.alias("n")
    given = F.when(F.size(F.from_json("n.settings", "map<string,string>")) > 0, F.col("n.settings"))
    return old.join(new, "id", "full_outer").select("id", F.coalesce(given, "o.settings", "n.settings").alias("settings"))


def effective(current: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, value, changed): the settings in effect under overrides; a null override is skipped, and without one the value stays."""
    both = current.alias("c").join(overrides.alias("o"), "key", "left")
    value = F.coalesce("o.value", "c.value")
    return both.select("key", value.alias("value"), (~value.eqNullSafe(F.col("c.value"))).alias("changed"))


def consequences(merged: DataFrame) -> DataFrame:
    """(requires_reindex, requires_vector_reset) of settings that changed."""
    moved = F.collect_set(F.when(F.col("changed"), F.col("key")))
    model = F.arrays_overlap(moved, F.array(*map(F.lit, ("embeddings_provider", "embeddings_model", "embeddings_dims"))))
    return merged.filter(F.col("key").startswith("embeddings_")).agg(model.alias("requires_reindex"), F.array_contains(moved, "embeddings_dims").alias("requires_vector_reset"))


def setup_mode(has_admin: DataFrame, has_config: DataFrame) -> DataFrame:
    """(mode): configured with both an administrator and a configuration, admin with the latter only, else full."""
    admin, config = (d.agg((F.count(F.lit(1)) > 0).alias(n)) for d, n in ((has_admin, "admin"), (has_config, "config")))
    return admin.join(F.broadcast(config)).select(_mode(F.col("admin"), F.col("config")).alias("mode"))


def setup_modes(rows: DataFrame, by: str, admin: Column, config: Column) -> DataFrame:
    """(by, mode) for each group of rows: as ``setup_mode``, by whether any row is an administrator or a configuration."""
    found = rows.groupBy(by).agg(F.bool_or(F.coalesce(admin, F.lit(False))).alias("_admin"), F.bool_or(F.coalesce(config, F.lit(False))).alias("_config"))
    return found.select(by, _mode(F.col("_admin"), F.col("_config")).alias("mode"))


def _mode(admin: Column, config: Column) -> Column:
    return F.when(admin & config, "configured").when(config, "admin").otherwise("full")

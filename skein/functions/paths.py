"""Suffixes, languages, extensions, breadcrumbs and listings of file paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LANGUAGES, TEXT_SUFFIXES


def suffix(path: Column) -> Column:
    """The last dot and what follows in a file name, lower-cased; empty for bare dot files and trailing dots."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def indexable(path: Column) -> Column:
    """Whether the suffix is on the list of source and text files."""
    return suffix(path).isin(*LANGUAGES, *TEXT_SUFFIXES)


def detect_language(path: Column, override: Column | None = None) -> Column:
    """The language of a suffix, ``text`` for others; an override other than ``auto`` or empty wins."""
    table = F.create_map(*[F.lit(x) for x in chain(*LANGUAGES.items())])
    found = F.coalesce(F.try_element_at(table, suffix(path)), F.lit("text"))
    if override is None:
        return found
    return F.when(override.isNull() | override.isin("auto", ""), found).otherwise(override)


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path, lower-cased."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def extension_label(ext: Column) -> Column:
    return F.when(ext == "", "(none)").otherwise(F.concat(F.lit("."), ext))


def breadcrumbs(path: Column) -> Column:
    """(name, path) for each non-empty component, cumulative."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(x.alias("name"), F.array_join(F.slice(parts, 1, i + 1), "/").alias("path")))


def list_dir(files: DataFrame, folder: str = "") -> DataFrame:
    """(name, type, size, path) of the direct children of a folder: folders first, then by name; folders have no size."""
    base = folder.strip("/")
    if any(part == ".." for part in base.split("/")):
        raise ValueError("the folder has to be inside the repository")
    lead = f"{base}/" if base else ""
    rest = F.substring(F.col("file_path"), len(lead) + 1, 1 << 30)
    inside = files.filter(F.col("file_path").startswith(lead)).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), F.contains(rest, F.lit("/")).alias("deep"), "size")
    kind = F.when(F.col("deep"), "directory").otherwise("file").alias("type")
    rows = inside.groupBy("name", "deep").agg(F.max("size").alias("size"))
    out = rows.select("name", kind, F.when(~F.col("deep"), F.col("size")).alias("size"), F.concat(F.lit(lead), "name").alias("path"))
    return out.orderBy("type", "name")

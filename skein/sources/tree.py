"""Data source ``repo_tree``: the text files of a folder, hidden and underscore names included.

Options: ``path`` (a folder that all executors see), ``repo`` (its name), ``excludes`` (globs, one a line), ``max_kb``,
``folders_per_partition``.  Folders that match an exclusion are not entered; files pass by suffix and size; line ends become
line feeds and broken UTF-8 becomes U+FFFD; unreadable files are skipped.

The driver lists the root only; each folder in it is walked by a task.  With the option ``pushdown`` filters on ``file_path``
(equal, one of, a prefix) and ``size`` are pushed down: folders that cannot hold a match are not entered, and files that
do not match are not opened.  Spark keeps what was pushed with the DataFrame that was loaded, so that one which was loaded with
``pushdown`` is for one use in one plan.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from ..functions.globs import compile_globs
from ..model import EXCLUDES, LANGUAGES, TEXT_SUFFIXES

SCHEMA = "repo_name string, file_path string, size long, content string"
#: The folder of rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def matcher(globs: Sequence[str]):
    """A test of one path by itself."""
    if not globs:
        return lambda path: False
    whole, part = (re.compile(r.replace(r"\z", r"\Z")) for r in compile_globs(globs))
    return lambda path: bool(whole.match(path) or whole.match("/" + path) or any(part.match(c) for c in path.split("/")))


def suffix_of(name: str) -> str:
    return PurePosixPath(name).suffix.lower()


@dataclass
class Wanted:
    """What pushed filters leave: paths and prefixes, all of which have to hold, and bounds of the size."""

    paths: set[str] | None = None
    prefixes: list[str] = field(default_factory=list)
    least: int = 0
    most: int | None = None

    def path(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(p) for p in self.prefixes)

    def below(self, folder: str) -> bool:
        """Whether a folder, named with its stroke, can hold a path that is wanted."""
        return (self.paths is None or any(p.startswith(folder) for p in self.paths)) and all(p.startswith(folder) or folder.startswith(p) for p in self.prefixes)

    def fits(self, size: int) -> bool:
        return self.least <= size and (self.most is None or size <= self.most)

    def take(self, pushed: Filter) -> None:
        match pushed:
            case EqualTo(("file_path",), value):
                self.paths = {value} if self.paths is None else self.paths & {value}
            case In(("file_path",), values):
                self.paths = set(values) if self.paths is None else self.paths & set(values)
            case StringStartsWith(("file_path",), value):
                self.prefixes.append(value)
            case EqualTo(("size",), value):
                self.least, self.most = max(self.least, value), value if self.most is None else min(self.most, value)
            case GreaterThan(("size",), value) | GreaterThanOrEqual(("size",), value):
                self.least = max(self.least, value)
            case LessThan(("size",), value) | LessThanOrEqual(("size",), value):
                self.most = value if self.most is None else min(self.most, value)


def walk(root: str, globs: Sequence[str], max_kb: int, start: str = "", deep: bool = True, wanted: Wanted | None = None) -> Iterator[tuple[str, int]]:
    """(path, size) of all files that pass below ``start``, or in it alone, in order."""
    excluded, allowed, wanted = matcher(globs), {*LANGUAGES, *TEXT_SUFFIXES}, wanted or Wanted()
    for folder, folders, names in os.walk(os.path.join(root, start) if start else root):
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        lead = "" if here == "." else f"{here}/"
        folders[:] = sorted(d for d in folders if deep and not excluded(lead + d) and wanted.below(f"{lead}{d}/"))
        for name in sorted(names):
            path = lead + name
            if excluded(path) or suffix_of(name) not in allowed or not wanted.path(path):
                continue
            try:
                size = os.stat(os.path.join(folder, name)).st_size
            except OSError:
                continue
            if size <= max_kb * 1024 and wanted.fits(size):
                yield path, size


def read_text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


class _Folders(InputPartition):
    """Folders below the root, each to be walked whole; the empty name is the root without its folders."""

    def __init__(self, folders: list[str]) -> None:
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.repo = options.get("repo") or os.path.basename(self.root.rstrip("/"))
        self.globs = [g for g in (x.strip() for x in options.get("excludes", "\n".join(EXCLUDES)).split("\n")) if g]
        self.max_kb = int(options.get("max_kb", 500))
        self.batch = int(options.get("folders_per_partition", 1))
        self.wanted, self.pushdown = Wanted(), options.get("pushdown", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take what chooses files; Spark applies all filters to the rows again."""
        for pushed in filters:
            if self.pushdown:
                self.wanted.take(pushed)
            yield pushed

    def partitions(self) -> list[InputPartition]:
        excluded = matcher(self.globs)
        folders = sorted(f.name for f in os.scandir(self.root) if f.is_dir(follow_symlinks=False) and not excluded(f.name) and self.wanted.below(f"{f.name}/"))
        return [_Folders([""])] + [_Folders(folders[k : k + self.batch]) for k in range(0, len(folders), self.batch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for folder in partition.folders:
            for path, size in walk(self.root, self.globs, self.max_kb, folder, bool(folder), self.wanted):
                content = read_text(os.path.join(self.root, path))
                if content is not None:
                    yield self.repo, path, size, content


class RepoTree(DataSource):
    """``spark.read.format("repo_tree")`` after ``register(spark)``."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _saved(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the rows (folder, content) of one task; a file has its last name once it is whole, so that an attempt that is made again replaces it."""
    context, n = TaskContext.get(), 0
    for batch in batches:
        for folder, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            at = f"{root}/{folder}"
            os.makedirs(at, exist_ok=True)
            name = f"part-{context.partitionId():05d}-{n}.txt"
            with open(f"{at}/_{name}.{context.taskAttemptId()}", "wb") as f:
                f.write(content.as_buffer())
                f.write(b"\n")
            os.replace(f.name, f"{at}/{name}")
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])


def save(rows: DataFrame, root: str, by: Sequence[str], content: str = "content") -> int:
    """Write each row's text with a line feed as a file of its own, in folders ``name=value`` of the columns ``by``; the number of files.

    Tasks write to ``root``, a folder that all executors see, and there is no commit that goes through files one by one.  Values
    are escaped as in URLs and null has the name that Hive gives it; rows without a text are left out.
    """
    value = lambda c: F.coalesce(F.replace(F.url_encode(F.nullif(F.col(c).cast("string"), F.lit(""))), F.lit("+"), F.lit("%20")), F.lit(NO_VALUE))
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), value(c)) for c in by])
    found = rows.select(folder.alias("folder"), F.col(content).cast("binary").alias("content")).filter("content is not null")
    return found.mapInArrow(partial(_saved, root), "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def saved_value(path: Column, name: str) -> Column:
    """The value of a column in a path that ``save`` made."""
    return F.url_decode(F.nullif(F.nullif(F.regexp_extract(path, f"(?:^|/){name}=([^/]*)/", 1), F.lit("")), F.lit(NO_VALUE)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoTree)


def read_file(root: str, path: str) -> str:
    """One file below a root; paths that leave it are refused."""
    full = os.path.realpath(os.path.join(root, path.lstrip("/")))
    if os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError("the path leads out of the repository")
    content = read_text(full)
    if content is None:
        raise FileNotFoundError(path)
    return content


def lookup(files: DataFrame, repos: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo, path, status, error, content, size_bytes) of each file asked for (repo, path) among ``files`` (repo_name, file_path, content, size).

    A leading stroke of a path is dropped; an unknown repository (not among ``repos``, name) and a missing file are errors with a message.
    """
    asked = wanted.select("repo", "path", F.ltrim("path", F.lit("/")).alias("_path")).distinct()
    known = repos.select(F.col("name").alias("_name")).distinct()
    held = files.select(F.col("repo_name").alias("_repo"), F.col("file_path").alias("_file"), "content", F.col("size").alias("size_bytes"), F.lit(True).alias("_there"))
    both = asked.join(known, F.col("repo") == F.col("_name"), "left").join(held, (F.col("_name") == F.col("_repo")) & (F.col("_path") == F.col("_file")), "left")
    unknown = F.concat(F.lit("Repository '"), F.coalesce("repo", F.lit("")), F.lit("' not found in runtime settings"))
    missing = F.concat(F.lit("File not found: "), F.coalesce("path", F.lit("")))
    error = F.when(F.col("_name").isNull(), unknown).when(F.col("_there").isNull(), missing)
    return both.select("repo", "path", F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"), "content", "size_bytes")

"""Data source ``remote_listing``: hosted listings of repositories, a partition for each page.

Options: ``transport``, ``module:class`` of what fetches pages, with whatever options it takes; ``host`` to choose one host;
``pushdown``.  A listing is ordered by last activity, newest first, and a transport tells the span of activity of each of its
pages, so that with ``pushdown`` a filter on host or last activity keeps pages from being fetched at all; Spark applies it
to the rows once more.

Spark keeps what was pushed to a source with the DataFrame that was loaded, so that a second use of the same DataFrame, or two
uses in one plan, would see the pages of one filter only.  ``pushdown`` is therefore off unless it is asked for, and a
DataFrame that was read with it is for one use; ``read`` it anew for another.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "host string, id long, full_name string, visibility string, last_activity_at long, page string"


@dataclass
class Page(InputPartition):
    """One page of a host's listing, and what is known of it before it is fetched."""

    host: str
    name: str
    least: int | None = None
    most: int | None = None


class Transport(Protocol):
    """What fetches pages; made from the source's options, on the driver and again in each task."""

    def __init__(self, options: dict[str, str]) -> None: ...

    def pages(self) -> Iterable[Page]: ...

    def fetch(self, page: Page) -> Iterable[dict]: ...


class Folder:
    """Pages kept as files of JSON lines, ``<path>/host=<host>/page=<least>-<most>/``, in any store that Arrow opens."""

    def __init__(self, options: dict[str, str]) -> None:
        from pyarrow import fs

        path = options["path"]
        self.system, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def _listed(self, path: str) -> list:
        from pyarrow import fs

        return sorted(self.system.get_file_info(fs.FileSelector(path)), key=lambda f: f.base_name)

    def pages(self) -> Iterator[Page]:
        for host in self._listed(self.root):
            if host.base_name.startswith("host="):
                for page in self._listed(host.path):
                    least, _, most = page.base_name.removeprefix("page=").partition("-")
                    yield Page(host.base_name.removeprefix("host="), page.base_name.removeprefix("page="), int(least), int(most))

    def fetch(self, page: Page) -> Iterator[dict]:
        for file in self._listed(f"{self.root}/host={page.host}/page={page.name}"):
            if file.base_name.endswith(".json"):
                with self.system.open_input_stream(file.path) as f:
                    for line in f.read().decode().split("\n"):
                        if line:
                            yield json.loads(line)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        module, _, name = options.get("transport", f"{__name__}:Folder").partition(":")
        self.transport = getattr(importlib.import_module(module), name)
        self.hosts: set[str] | None = {options["host"]} if options.get("host") else None
        self.least: int | None = None
        self.most: int | None = None
        self.pushdown = options.get("pushdown", "false").lower() == "true"

    def _narrow(self, hosts: set[str]) -> None:
        self.hosts = hosts if self.hosts is None else self.hosts & hosts

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take what chooses pages; all filters go back, as a page holds rows on either side of a bound."""
        for f in filters:
            match f if self.pushdown else None:
                case EqualTo(("host",), value):
                    self._narrow({value})
                case In(("host",), values):
                    self._narrow(set(values))
                case EqualTo(("last_activity_at",), value):
                    self._bound(value, value)
                case GreaterThan(("last_activity_at",), value) | GreaterThanOrEqual(("last_activity_at",), value):
                    self._bound(value, None)
                case LessThan(("last_activity_at",), value) | LessThanOrEqual(("last_activity_at",), value):
                    self._bound(None, value)
            yield f

    def _bound(self, least: int | None, most: int | None) -> None:
        if least is not None:
            self.least = least if self.least is None else max(self.least, least)
        if most is not None:
            self.most = most if self.most is None else min(self.most, most)

    def _wanted(self, page: Page) -> bool:
        if self.hosts is not None and page.host not in self.hosts:
            return False
        over = self.most is not None and page.least is not None and page.least > self.most
        under = self.least is not None and page.most is not None and page.most < self.least
        return not over and not under

    def partitions(self) -> list[InputPartition]:
        return [p for p in self.transport(self.options).pages() if self._wanted(p)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in self.transport(self.options).fetch(partition):
            yield partition.host, row["id"], row.get("full_name"), row.get("visibility"), row.get("last_activity_at"), partition.name


class RemoteListing(DataSource):
    """``spark.read.format("remote_listing")`` after ``read`` or ``spark.dataSource.register(RemoteListing)``."""

    @classmethod
    def name(cls) -> str:
        return "remote_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str | None = None, **options: str) -> DataFrame:
    """The listing as rows; ``path`` and other options are the transport's."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteListing)
    reader = spark.read.format("remote_listing").options(**options)
    return reader.load(path) if path else reader.load()


def save_pages(rows: DataFrame, path: str, span: int = 500) -> None:
    """Write ``rows`` (host, id, full_name, visibility, last_activity_at) as pages of equal spans of activity, as ``Folder`` serves them."""
    from pyspark.sql import functions as F

    least = F.floor(F.col("last_activity_at") / span) * span
    paged = rows.withColumn("page", F.concat(least.cast("string"), F.lit("-"), (least + span - 1).cast("string")))
    paged.repartition("host", "page").write.mode("overwrite").partitionBy("host", "page").json(path)

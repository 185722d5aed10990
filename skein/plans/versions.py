"""Tables whose readers never see a replacement half done: rows lie under versions, and one list of commits says which count.

``base/data/<table>`` is partitioned by part (a repository, or '' for a table that is replaced as a whole) and version.
A version counts once a commit names it, and a commit is one file, however many tables and parts it names: it is there
or it is not.  What a writer that failed has left behind is named by no commit and is read by nobody; ``vacuum`` removes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMITS = "number long, id string, table string, part string, version string, rows long"


class VersionedStore:
    """A store at ``base``; writers ``write`` first and ``commit`` then, and both can be done again after a crash."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def commits(self) -> DataFrame:
        path = f"{self.base}/commits"
        return self.spark.read.schema(COMMITS).parquet(path) if self._exists(path) else self.spark.createDataFrame([], COMMITS)

    def current(self, table: str | None = None) -> DataFrame:
        """(table, part, version, rows) that count: the last commit of each part; removed parts have a null version and are left out."""
        known = self.commits() if table is None else self.commits().filter(F.col("table") == table)
        last = known.groupBy("table", "part").agg(F.max(F.struct("number", "id", "version", "rows")).alias("c"))
        return last.select("table", "part", "c.version", "c.rows").filter("version is not null")

    def write(self, rows: DataFrame, table: str, part: str | None = None) -> tuple[str, Observation]:
        """Write ``rows`` under a new version, by their column ``part`` or whole; nobody reads them before a commit.

        The version, and how many rows went into it.
        """
        version, written = uuid.uuid4().hex, Observation()
        by = F.lit("") if part is None else F.coalesce(F.col(part).cast("string"), F.lit(""))
        out = rows.observe(written, F.count(F.lit(1)).alias("rows")).withColumn("_part", by).withColumn("_version", F.lit(version))
        out.write.mode("append").partitionBy("_part", "_version").parquet(f"{self.base}/data/{table}")
        return version, written

    def written(self, table: str, version: str) -> DataFrame:
        """(table, part, version, rows) of what a writer left under a version, as a commit takes it."""
        rows = self.spark.read.parquet(f"{self.base}/data/{table}").filter(F.col("_version") == version)
        return rows.groupBy(self._part().alias("part")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table"), "part", F.lit(version).alias("version"), "rows")

    @staticmethod
    def _part() -> Column:
        return F.coalesce(F.col("_part").cast("string"), F.lit(""))  # the partition of the empty string is read as null

    def commit(self, changes: DataFrame) -> None:
        """Make ``changes`` (table, part, version, rows) count, all at once; a null version removes a part."""
        number = (self.commits().agg(F.max("number")).first()[0] or 0) + 1
        rows = changes.select(F.lit(number).cast("long").alias("number"), F.lit(uuid.uuid4().hex).alias("id"), "table", "part", "version", F.col("rows").cast("long").alias("rows"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.base}/commits")  # a row for each part: one file is what makes it atomic

    def replace(self, rows: DataFrame, table: str, part: str | None = None, empty: DataFrame | None = None) -> None:
        """Replace the parts in ``rows``, or the whole table; parts in ``empty`` (part) that have no rows are removed."""
        version, written = self.write(rows, table, part)
        if written.get["rows"]:
            changes = self.written(table, version)
        else:  # nothing was written, and a table as a whole is empty now
            gone = [] if part is not None else [(table, "", None, 0)]
            changes = self.spark.createDataFrame(gone, "table string, part string, version string, rows long")
        if empty is not None:
            changes = changes.union(self.removed(table, empty.join(changes.select("part"), "part", "left_anti")))
        self.commit(changes)

    @staticmethod
    def removed(table: str, parts: DataFrame) -> DataFrame:
        return parts.select(F.lit(table).alias("table"), "part", F.lit(None).cast("string").alias("version"), F.lit(0).cast("long").alias("rows"))

    def read(self, table: str) -> DataFrame:
        """The rows that count.  The versions are joined on the partition columns, so that other versions' files are not read."""
        now = self.current(table).select(F.col("part").alias("_p"), F.col("version").alias("_v"))
        rows = self.spark.read.parquet(f"{self.base}/data/{table}")
        return rows.join(now, (self._part() == F.col("_p")) & (F.col("_version") == F.col("_v")), "left_semi").drop("_part", "_version")

    def stale(self, table: str) -> DataFrame:
        """(part, version) of files that no reader takes: replaced, removed, or never committed."""
        found = self.spark.read.parquet(f"{self.base}/data/{table}").select(self._part().alias("part"), F.col("_version").alias("version")).distinct()
        return found.join(self.current(table).select("part", "version"), ["part", "version"], "left_anti")

    def vacuum(self, table: str) -> int:
        """Delete the folders of stale versions, once no reader that began earlier is left; the number of folders."""
        jvm = self.spark.sparkContext._jvm
        folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
        found = self.spark.read.parquet(f"{self.base}/data/{table}").select(self._part().alias("part"), F.col("_version").alias("version"), folder.alias("folder")).distinct()
        gone = found.join(self.current(table).select("part", "version"), ["part", "version"], "left_anti").select("folder").distinct()
        done = 0
        for row in gone.toLocalIterator():
            target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["folder"]))
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            done += 1
        return done


def delete_repos(store: VersionedStore, names: DataFrame) -> None:
    """Delete repositories (name) everywhere; unknown names change nothing.

    Their chunks, their rows of the catalogue ``repos`` and of the configuration ``config``, and their requests in ``queue`` go in
    one commit: the new catalogue, configuration and queue are written first, and count together with the removal of the
    chunks.  A crash before the commit changes nothing, and doing it again after one removes nothing more.
    """
    gone = names.select("name").filter("name is not null").distinct()
    changes = store.removed("chunks", gone.join(store.current("chunks").select(F.col("part").alias("name")), "name", "left_semi").select(F.col("name").alias("part")))
    for table, key in (("config", "name"), ("repos", "name"), ("queue", "repo_name")):
        kept = store.read(table).join(gone.select(F.col("name").alias(key)), key, "left_anti")
        version, written = store.write(kept, table)
        if written.get["rows"]:
            changes = changes.union(store.written(table, version))
        else:
            changes = changes.union(store.removed(table, store.spark.createDataFrame([("",)], "part string")))
    store.commit(changes)

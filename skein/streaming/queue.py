"""Re-indexing requests as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import REQUESTS


def consume(spark: SparkSession, path: str, checkpoint: str, repos: DataFrame, handle: Callable[[str], None], files_per_batch: int = 10) -> StreamingQuery:
    """Handle each request's repositories, oldest first; a null name means all, unknown names are passed over.

    A batch is acknowledged by its checkpoint after it ran: a crash runs it again, so handlers replace and never append.
    """
    requests = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).json(path)

    def run(batch: DataFrame, _: int) -> None:
        names = repos.select("name")
        named = batch.filter("repo_name is not null").join(names, batch.repo_name == names.name).select("name", "requested_at")
        every = batch.filter("repo_name is null").select("requested_at").crossJoin(names).select("name", "requested_at")
        order = named.union(every).groupBy("name").agg(F.min("requested_at").alias("first")).orderBy("first", "name")
        for row in order.toLocalIterator():  # repositories, each of which starts its own distributed job
            handle(row["name"])

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

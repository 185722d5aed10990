"""A table replayed as a stream: slices in order of time, each a micro-batch or more, and what comes of them as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for the queries that start inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def write_slices(rows: DataFrame, time: str, path: str, first: int, last: int, of: int) -> None:
    """Append slices ``first`` to ``last`` (exclusive) of ``of`` equal spans of time; a later slice is written after an earlier one, so that a stream reads it later."""
    span = rows.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    place = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))) * of / (F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp")) + 1))
    sliced = rows.join(F.broadcast(span)).withColumn("_slice", F.coalesce(F.least(place, F.lit(of - 1)), F.lit(0))).drop("lo", "hi")
    for k in range(first, last):
        sliced.filter(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(path)


def append_batches(changes: DataFrame, table: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write each batch's rows to a partition of its own, so that a batch that runs again after a crash replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(rows: DataFrame, time: str, base: str, start: Callable[[DataFrame, str], StreamingQuery], slices: int = 4) -> list[StreamingQuery]:
    """Replay ``rows`` (with values of ``time``) through ``start(stream, checkpoint)``, which is stopped and started again after each slice.

    A slice is one micro-batch, however many files it has: files of one slice that came in several would move the watermark
    past each other's rows, which would be dropped as late.
    """
    spark, runs = rows.sparkSession, []
    for k in range(slices):
        write_slices(rows, time, f"{base}/input", k, k + 1, slices)
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/input")
        run = start(stream, f"{base}/checkpoint")
        run.awaitTermination()
        runs.append(run)
    return runs

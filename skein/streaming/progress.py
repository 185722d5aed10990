"""Progress of an indexing run while it runs: metrics that each micro-batch observes, kept as rows by a listener."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import chunk

NAME = "index_progress"
ROWS = "run string, batch long, files long, chunks long, calls long, elapsed_ms long"


def metrics(first: Column, calls_of: int = 20) -> list[Column]:
    """What a batch of chunks counts: files (by their first chunk), chunks, and the calls that embed them."""
    n = F.count(F.lit(1))
    return [F.count_if(first).alias("files"), n.alias("chunks"), F.ceil(n / calls_of).alias("calls")]


@dataclass
class Progress(StreamingQueryListener):
    """Keeps one row for each batch that observed anything; a run's last row comes before ``ended`` is set."""

    rows: list[tuple] = field(default_factory=list)
    ended: threading.Event = field(default_factory=threading.Event)
    began: float = field(default_factory=time.monotonic)

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self.began = time.monotonic()

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(NAME)
        if seen is not None and seen["chunks"]:
            self.rows.append((str(event.progress.runId), event.progress.batchId, seen["files"], seen["chunks"], seen["calls"], round(1000 * (time.monotonic() - self.began))))

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self.ended.set()


def index_stream(files: DataFrame, table: str, checkpoint: str, size: int = 400, overlap: int = 50) -> StreamingQuery:
    """Cut a stream of files into chunks and write each batch's to its own partition of ``table``, observing progress."""
    chunks = chunk.sliding_chunks(files, size, overlap)
    watched = chunks.observe(NAME, *metrics(F.col("chunk_index") == 0))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return watched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, files: DataFrame, table: str, checkpoint: str, wait: float = 120) -> DataFrame:
    """Run ``index_stream`` to its end; (run, batch, files, chunks, calls, elapsed_ms), a row for each batch."""
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        index_stream(files, table, checkpoint).awaitTermination()
        if not listener.ended.wait(wait):
            raise TimeoutError("the listener did not hear of the end of the run")
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame(listener.rows, ROWS)

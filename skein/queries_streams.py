"""Queries that replay a table as a stream, with a restart in between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans import adapters, scratch
from .queries import _J, _LATEST, query, store, table
from .streaming import jobs as job_stream
from .streaming import progress, replay, sessions


@query(
    "job_states_stream",
    f"{_J} SELECT *, status IN ('pending', 'running') AND updated_at < (SELECT max(created_at) FROM jobs) - INTERVAL 1 DAY AS stale FROM ({_LATEST})",
)
def job_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions in four spans of time, a restart after each: the last state of each job, and the jobs that were lost."""
    base, rows = scratch.folder(spark), store(spark, sf_dir, "jobs").filter("created_at is not null")

    def start(stream: DataFrame, checkpoint: str):
        return replay.append_batches(job_stream.states(stream.withColumn("created_at", F.col("created_at").cast("timestamp"))), f"{base}/changes", checkpoint)

    with replay.keyed_state(spark):
        replay.replayed(rows, "created_at", base, start)
    now = job_stream.current(spark.read.schema(job_stream.OUT).parquet(f"{base}/changes"))
    return now.withColumns({c: F.col(c).cast(rows.schema["created_at"].dataType) for c in ("first_at", "updated_at")})


def _session_events(events: DataFrame) -> DataFrame:
    """Every event opens a session of its own; an error closes the session of the event 40 before it."""
    opened = events.select(F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"), "user_id", F.lit("open").alias("action"), F.col("ts").alias("at"))
    closed = events.filter("event_type = 'error'").select(F.sha2((F.col("event_id") - 40).cast("string"), 256).alias("token_hash"), F.lit(None).cast("long").alias("user_id"), F.lit("close").alias("action"), F.col("ts").alias("at"))
    return opened.union(closed)


@query(
    "session_stream",
    """WITH s AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS token_hash, user_id, ts AS at, ts + INTERVAL 24 HOUR AS expires_at FROM events),
      j AS (SELECT s.*, (SELECT min(c.ts) FROM events c WHERE c.event_type = 'error' AND c.event_id = s.event_id + 40 AND c.ts >= s.at AND c.ts < s.expires_at) AS closed_at FROM s), n AS (SELECT max(ts) AS t FROM events)
      SELECT token_hash, user_id, expires_at, CASE WHEN closed_at IS NOT NULL THEN closed_at WHEN expires_at <= t THEN expires_at END AS ended_at,
        CASE WHEN closed_at IS NOT NULL THEN 'closed' WHEN expires_at <= t THEN 'expired' ELSE 'live' END AS how FROM j, n""",
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions opened, closed and expired while the stream is read, with a restart after each fourth of the time."""
    base, events = scratch.folder(spark), table(spark, sf_dir, "events").filter("ts is not null")

    def start(stream: DataFrame, checkpoint: str):
        return replay.append_batches(sessions.lives(stream.withColumn("at", F.col("at").cast("timestamp"))), f"{base}/changes", checkpoint)

    with replay.keyed_state(spark):
        replay.replayed(_session_events(events), "at", base, start)
    now = sessions.current(spark.read.schema(sessions.OUT).parquet(f"{base}/changes"))
    return now.withColumns({c: F.col(c).cast(events.schema["ts"].dataType) for c in ("expires_at", "ended_at")})


@query(
    "index_progress_stream",
    f"""{adapters.cte("files")}, k AS (SELECT doc_id % 4 AS part, count(*) AS files, CAST(sum(greatest(1, ceil(length(content) / 1400.0))) AS BIGINT) AS chunks FROM files WHERE length(content) > 0 GROUP BY ALL)
      SELECT CAST(row_number() OVER (ORDER BY part) AS INT) AS step, files, chunks, CAST(ceil(chunks / 20.0) AS BIGINT) AS calls, CAST(sum(chunks) OVER (ORDER BY part) AS BIGINT) AS chunks_so_far, true AS timed FROM k""",
)
def index_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files come in four parts, each one micro-batch of one stream; what it observed of them, in order, while they were cut and written."""
    base, files = scratch.folder(spark), store(spark, sf_dir, "files").select("repo_name", "file_path", "content", "doc_id")
    runs = []
    for part in range(4):
        # A part may be several files; they are one batch, cut and written by as many tasks as there are.
        files.filter(F.col("doc_id") % 4 == part).write.parquet(f"{base}/input/part={part}")
        stream = spark.readStream.schema(files.schema).parquet(f"{base}/input/*")
        runs.append(progress.watch(spark, stream, f"{base}/chunks", f"{base}/checkpoint").withColumn("part", F.lit(part)))
    steps = reduce(DataFrame.union, runs).groupBy("part").agg(F.sum("files").alias("files"), F.sum("chunks").alias("chunks"), F.min("elapsed_ms").alias("since"), F.max("elapsed_ms").alias("until"))
    order = Window.orderBy("part")  # four rows
    so_far = F.sum("chunks").over(order)
    return steps.select(F.row_number().over(order).alias("step"), "files", "chunks", F.ceil(F.col("chunks") / 20).alias("calls"), so_far.alias("chunks_so_far"), (F.col("until") >= F.col("since")).alias("timed"))


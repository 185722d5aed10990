"""Jobs, sessions and progress as streams: restarts, timers, late rows, the size of the state."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.streaming import jobs, progress, replay, sessions

T0 = datetime(2024, 1, 1)
JOB = "job_id string, created_at timestamp, event_id long, status string, tool string, error_message string, params string"


def test_lost_jobs_after_a_restart(spark, tmp_path):
    """A job that was running when the reader stopped becomes stale by its timer once later events pass; one that goes on does not."""
    hour = lambda h: T0 + timedelta(hours=h)
    first = [("a", hour(0), 1, "pending", "t", None, "{}"), ("b", hour(0), 2, "running", "t", None, None), ("c", hour(1), 3, "running", "t", None, None), ("a", hour(1), 4, "running", "t", None, "{}")]
    second = [("c", hour(20), 5, "done", "t", None, "x"), ("b", hour(0), 6, "error", "t", "late: behind the watermark", None), ("d", hour(60), 7, "pending", "t", None, None), ("d", hour(60), 8, "running", "t", None, None)]
    base, table = str(tmp_path), str(tmp_path / "changes")
    with replay.keyed_state(spark):
        for k, rows in enumerate((first, second)):
            spark.createDataFrame(rows, JOB).coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(JOB).parquet(f"{base}/in")
            replay.append_batches(jobs.states(stream), table, f"{base}/cp").awaitTermination()
            if k == 0:
                assert {(r["job_id"], r["status"], r["stale"]) for r in jobs.current(spark.read.schema(jobs.OUT).parquet(table)).collect()} == {("a", "running", False), ("b", "running", False), ("c", "running", False)}
    now = {r["job_id"]: r for r in jobs.current(spark.read.schema(jobs.OUT).parquet(table)).collect()}
    assert {k: (r["status"], r["stale"], r["transitions"]) for k, r in now.items()} == {"a": ("running", True, 2), "b": ("running", True, 1), "c": ("done", False, 2), "d": ("running", False, 2)}
    assert now["a"]["first_at"] == hour(0) and now["a"]["updated_at"] == hour(1) and now["c"]["params"] == "x"


def test_sessions_end_and_their_state_shrinks(spark, tmp_path):
    base, table = str(tmp_path), str(tmp_path / "changes")
    rows = [(f"s{k}", k, "open", T0 + timedelta(hours=k)) for k in range(60)] + [("s50", None, "close", T0 + timedelta(hours=51)), ("s1", None, "close", T0 + timedelta(hours=40)), ("never", None, "close", T0), ("s59", 9, "open", T0 + timedelta(hours=59, minutes=5))]
    frame = spark.createDataFrame(rows, "token_hash string, user_id long, action string, at timestamp")
    with replay.keyed_state(spark):
        runs = replay.replayed(frame, "at", base, lambda stream, cp: replay.append_batches(sessions.lives(stream), table, cp))
    now = {r["token_hash"]: r for r in sessions.current(spark.read.schema(sessions.OUT).parquet(table)).collect()}
    last = T0 + timedelta(hours=59, minutes=5)
    for k in range(60):
        expires = T0 + timedelta(hours=k + 24)
        how = "closed" if k == 50 else "expired" if expires <= last else "live"
        assert (now[f"s{k}"]["how"], now[f"s{k}"]["expires_at"], now[f"s{k}"]["user_id"]) == (how, expires, k)
    assert now["s50"]["ended_at"] == T0 + timedelta(hours=51) and now["s1"]["ended_at"] == T0 + timedelta(hours=25) and "never" not in now
    held = [p["stateOperators"][0]["numRowsTotal"] for run in runs for p in run.recentProgress if p["stateOperators"]]
    live = sum(r["how"] == "live" for r in now.values())
    # Sixty sessions were opened; the store holds what is still live, and was larger before.
    assert live < 60 and held[-1] < max(held)


def test_progress_adds_up(spark, tmp_path):
    base = str(tmp_path)
    files = spark.createDataFrame([("r", f"f{k}", "x" * (100 * k), k) for k in range(40)], "repo_name string, file_path string, content string, doc_id long")
    for part in range(3):
        files.filter(F.col("doc_id") % 3 == part).coalesce(1).write.parquet(f"{base}/in/part={part}")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    rows = progress.watch(spark, stream, f"{base}/chunks", f"{base}/cp").collect()
    written = spark.read.parquet(f"{base}/chunks")
    assert len(rows) == 3 and sum(r["files"] for r in rows) == 39 and sum(r["chunks"] for r in rows) == written.count()
    assert {r["batch"]: r["chunks"] for r in rows} == {r["batch"]: r["count"] for r in written.groupBy("batch").count().collect()}
    assert all(r["calls"] == -(-r["chunks"] // 20) and r["elapsed_ms"] >= 0 for r in rows)


def test_slices_of_many_files_lose_no_rows(spark, tmp_path):
    """Files of one slice whose times go backwards are one batch; sessions and jobs that share a bucket keep apart."""
    rows = spark.range(1200).selectExpr("concat('s', id % 600) AS token_hash", "id AS user_id", "if(id < 600, 'open', 'close') AS action", "timestamp'2024-01-01' + make_dt_interval(0, 0, id) AS at")
    backwards = rows.repartitionByRange(12, F.desc("at"))
    with replay.keyed_state(spark):
        replay.replayed(backwards, "at", str(tmp_path), lambda stream, cp: replay.append_batches(sessions.lives(stream), str(tmp_path / "changes"), cp))
    now = {r["token_hash"]: (r["user_id"], r["how"], r["ended_at"]) for r in sessions.current(spark.read.schema(sessions.OUT).parquet(str(tmp_path / "changes"))).collect()}
    assert now == {f"s{k}": (k, "closed", T0 + timedelta(minutes=600 + k)) for k in range(600)}


def test_jobs_that_share_a_bucket(spark, tmp_path):
    """Jobs of files whose times go backwards, and a job of no name: last state, first time, number of transitions, stale ones."""
    rows = spark.range(1200).selectExpr("if(id % 600 = 0, NULL, concat('j', id % 600)) AS job_id", "timestamp'2024-01-01' + make_dt_interval(0, 0, id * 5) AS created_at", "id AS event_id", "if(id >= 600 AND id % 2 = 0, 'done', 'running') AS status", "'t' AS tool", "CAST(NULL AS string) AS error_message", "concat('p', id) AS params")
    with replay.keyed_state(spark):
        replay.replayed(rows.repartitionByRange(12, F.desc("created_at")), "created_at", str(tmp_path), lambda stream, cp: replay.append_batches(jobs.states(stream), str(tmp_path / "changes"), cp))
    now = {r["job_id"]: (r["status"], r["stale"], r["transitions"], r["params"], r["error_message"], r["first_at"]) for r in jobs.current(spark.read.schema(jobs.OUT).parquet(str(tmp_path / "changes"))).collect()}
    last = 1199 * 5
    for k in range(600):
        done, at = k % 2 == 0, (600 + k) * 5
        assert now[f"j{k}" if k else None] == ("done" if done else "running", not done and at + 1440 <= last, 2, f"p{600 + k}", None, T0 + timedelta(minutes=5 * k)), k
    assert len(now) == 600


def test_progress_has_a_batch_for_each_part(spark, tmp_path):
    """Parts of many files are as many batches as there are parts."""
    from skein import queries

    files = spark.range(400).selectExpr("id AS doc_id", "repeat('x', CAST(id AS int)) AS text", "concat('src', id % 3) AS source", "'de' AS lang", "id AS n_chars")
    files.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    seen, watch = [], progress.watch

    def counted(*args, **more):
        found = watch(*args, **more)
        seen.append(found.count())
        return found

    progress.watch = counted
    try:
        steps = queries.QUERIES["index_progress_stream"](spark, str(tmp_path)).orderBy("step").collect()
    finally:
        progress.watch = watch
    assert seen == [1, 1, 1, 1] and [r["files"] for r in steps] == [99, 100, 100, 100] and all(r["timed"] for r in steps)

"""Jobs and the request queue as tables of state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(jobs: DataFrame, limit: int = 50, status: str = "") -> DataFrame:
    """The newest rows; an empty status means all."""
    found = jobs.filter(F.col("status") == status) if status else jobs
    return found.orderBy(F.desc("created_at"), "event_id").limit(limit)


def latest(jobs: DataFrame) -> DataFrame:
    """The last transition of each job, by one partial aggregate."""
    state = F.struct("created_at", "event_id", "status", "tool", "error_message", "params")
    return jobs.groupBy("job_id").agg(F.max(state).alias("s"), F.min("created_at").alias("first_at"), F.count(F.lit(1)).alias("transitions")).select(
        "job_id", "s.status", "s.tool", "s.error_message", "s.params", "first_at", F.col("s.created_at").alias("updated_at"), "transitions"
    )


def result_view(jobs: DataFrame) -> DataFrame:
    """What a reader of a job's result gets: not_ready, error with its message, or done."""
    view = F.when(F.col("status").isin("pending", "running"), "not_ready").when(F.col("status") == "error", "error").otherwise("done")
    return jobs.select("job_id", view.alias("view"), F.when(view == "error", F.coalesce("error_message", F.lit("unknown error"))).alias("message"))


def matches(words: str) -> Column:
    """A trimmed, lower-cased substring in id, tool, status or message; blank matches all."""
    needle = words.strip().lower()
    hay = [F.col("job_id"), F.col("tool"), F.col("status"), F.coalesce("error_message", F.lit(""))]
    out = F.lit(not needle)
    for column in hay:
        out = out | F.contains(F.lower(column), F.lit(needle))
    return out


def stale(jobs: DataFrame, now: Column, older_than: str) -> DataFrame:
    """Jobs whose last state is not final and older than an interval."""
    return latest(jobs).filter(F.col("status").isin("pending", "running") & (F.col("updated_at") < now - F.expr(f"INTERVAL {older_than}")))


def pending(queue: DataFrame, limit: int = 10) -> DataFrame:
    """The oldest requests that are not processed."""
    return queue.filter("processed_at is null").orderBy("requested_at", "id").limit(limit)


def resolve(queue: DataFrame, repos: DataFrame) -> DataFrame:
    """(id, name): requests with their repositories; a null name means all, unknown names give none.

    Split into an equi-join and, for the null ones, every repository of the catalogue, so no OR join is left.
    """
    open_ = queue.filter("processed_at is null").select("id", "repo_name")
    names = repos.select("name")
    named = open_.filter("repo_name is not null").join(names, open_.repo_name == names.name).select("id", "name")
    return named.union(open_.filter("repo_name is null").select("id").crossJoin(names))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now)


def create(requests: DataFrame, now: Column) -> DataFrame:
    """New jobs (tool, params) with an id of their own, pending."""
    return requests.select(F.uuid().alias("job_id"), "tool", F.lit("pending").alias("status"), "params", now.alias("created_at"))


def advance(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with further transitions; jobs that it does not know are left out, as an update finds no row for them."""
    return jobs.unionByName(changes.join(jobs.select("job_id").distinct(), "job_id", "left_semi"), allowMissingColumns=True)


def read(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(job_id, view, message, result) for each id asked for; the result is decoded only of jobs that are done."""
    state = latest(jobs)
    found = result_view(state).join(state.select("job_id", F.try_parse_json("params").alias("decoded")), "job_id").withColumn("result", F.when(F.col("view") == "done", F.col("decoded")))
    known = wanted.select("job_id").distinct().join(found, "job_id", "left")
    return known.select("job_id", F.coalesce("view", F.lit("not_found")).alias("view"), F.when(F.col("view").isNull(), "job not found").otherwise(F.col("message")).alias("message"), "result")


def enqueue(queue: DataFrame, requests: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """The queue with further requests; with a catalogue, those for unknown repositories are refused (null asks for all)."""
    if repos is not None:
        names = repos.select(F.col("name").alias("repo_name"))
        requests = requests.join(names, "repo_name", "left_semi").unionByName(requests.filter("repo_name is null"))
    return queue.unionByName(requests, allowMissingColumns=True)


def open_sessions(sessions: DataFrame, tokens: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Sessions of tokens (token, user_id) are added under their digest; those that ended are purged."""
    fresh = tokens.select(F.sha2("token", 256).alias("token_hash"), "user_id", (now + F.expr(f"INTERVAL '{hours}' HOUR")).alias("expires_at"))
    return live_sessions(sessions, now).unionByName(fresh)


def close_sessions(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    return sessions.join(tokens.select(F.sha2("token", 256).alias("token_hash")), "token_hash", "left_anti")


def of_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions go with their user."""
    return sessions.join(users.select("user_id"), "user_id", "left_semi")

"""The order of a repository's states: each transition against the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may follow a state; the first state of a repository is pending, or indexing where it was known before the log.
LEGAL = {"": ("pending", "indexing"), "pending": ("indexing",), "indexing": ("indexed", "error"), "indexed": ("indexing", "pending"), "error": ("indexing", "pending")}


def legal(before: Column, after: Column) -> Column:
    """Whether a transition may be; unknown and missing states are not."""
    out = F.lit(False)
    for state, following in LEGAL.items():
        out = out | ((F.coalesce(before, F.lit("")) == state) & after.isin(*following))
    return F.coalesce(out, F.lit(False))


def steps(log: DataFrame, bucket: str = "day") -> DataFrame:
    """``log`` (repo_name, at, seq, status) with before, legal, attempt and seconds (spent in the state before).

    attempt counts the entries into ``indexing`` so far.  Rows are ordered within a bucket of time, and each bucket starts
    from what the one before it ended with, so that a repository with most of the rows is not one task's.
    """
    rows = log.withColumn("_bucket", F.date_trunc(bucket, "at"))
    ends = rows.groupBy("repo_name", "_bucket").agg(F.max(F.struct("at", "seq", "status")).alias("_end"), F.count_if(F.col("status") == "indexing").alias("_n"))
    over = Window.partitionBy("repo_name").orderBy(F.col("_bucket").asc_nulls_first())
    carried = ends.select("repo_name", "_bucket", F.lag("_end").over(over).alias("_carried"), (F.sum("_n").over(over) - F.col("_n")).alias("_tried"))
    joined = rows.join(carried.withColumnsRenamed({"repo_name": "_repo", "_bucket": "_at"}), F.col("repo_name").eqNullSafe(F.col("_repo")) & F.col("_bucket").eqNullSafe(F.col("_at")))
    inside = Window.partitionBy("repo_name", "_bucket").orderBy("at", "seq")
    before = F.coalesce(F.lag(F.struct("at", "seq", "status")).over(inside), F.col("_carried"))
    attempt = F.col("_tried") + F.count_if(F.col("status") == "indexing").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = joined.withColumn("_before", before).withColumn("attempt", attempt)
    spent = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("_before.at").cast("timestamp"))) / 1_000_000
    return out.select(*[f"`{c}`" for c in log.columns], F.col("_before.status").alias("before"), legal(F.col("_before.status"), F.col("status")).alias("legal"), "attempt", spent.alias("seconds"))


def review(log: DataFrame, now: Column, stuck_after: str = "6 HOURS") -> DataFrame:
    """(repo_name, transitions, illegal, attempts, failures, seconds in each state, status, stuck), by one aggregate of the steps.

    The last state's time runs until ``now``; a repository is stuck if it has been indexing for longer than ``stuck_after``.
    """
    known = steps(log)
    spent = {s: F.sum(F.when(F.col("before") == s, F.col("seconds"))) for s in LEGAL if s}
    last = F.max(F.struct("at", "seq", "status"))
    summed = known.groupBy("repo_name").agg(
        F.count(F.lit(1)).alias("transitions"), F.count_if(~F.col("legal")).alias("illegal"), F.max("attempt").alias("attempts"), F.count_if(F.col("status") == "error").alias("failures"),
        last.alias("_last"), *[s.alias(f"_{n}") for n, s in spent.items()],
    )
    since = F.col("_last.at")
    rest = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1_000_000
    times = [F.round(F.coalesce(F.col(f"_{n}"), F.lit(0.0)) + F.when(F.col("_last.status") == n, rest).otherwise(0.0), 3).alias(f"{n}_seconds") for n in spent]
    stuck = (F.col("_last.status") == "indexing") & (since < now - F.expr(f"INTERVAL {stuck_after}"))
    return summed.select("repo_name", "transitions", "illegal", "attempts", "failures", *times, F.col("_last.status").alias("status"), stuck.alias("stuck"))

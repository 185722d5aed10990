"""Sessions as a stream: buckets of sessions, each of which ends by a timer a day after its start, or when it is closed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import buckets

OUT = "token_hash string, user_id long, expires_at long, ended_at long, how string"
_COLUMNS = [f.split()[0] for f in OUT.split(", ")]
#: What is kept of a live session.
_LIVE = {"token_hash": "object", "user_id": "Int64", "expires_at": "int64"}


class Sessions(StatefulProcessor):
    """What becomes of the sessions of a bucket; times are microseconds.  A session's state goes when it ends, so that the store holds live ones only.

    One timer for each bucket stands at the first end; all sessions that have ended by then go at once.
    """

    def __init__(self, lasts: int) -> None:
        self.lasts = lasts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", buckets.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows), ignore_index=True)
        events = events.assign(closing=events["action"] != "open").sort_values(["at", "closing"], kind="stable")
        held = buckets.load(self.live, _LIVE)
        known = dict(zip(held["token_hash"], zip(held["user_id"], held["expires_at"], strict=True), strict=True))
        out = []
        for token, at, closing, user in zip(events["token_hash"].tolist(), events["at"].tolist(), events["closing"].tolist(), events["user_id"].astype("Int64"), strict=True):
            if not closing:
                if token not in known:
                    known[token] = (user, at + self.lasts)
                    out.append((token, *known[token], pd.NA, "opened"))
            elif token in known and at < known[token][1]:
                out.append((token, *known.pop(token), at, "closed"))
        self._keep(pd.DataFrame([(t, *v) for t, v in known.items()], columns=[*_LIVE]))
        if out:
            yield self._rows(pd.DataFrame(out, columns=_COLUMNS))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = buckets.load(self.live, _LIVE)
        over = buckets.milliseconds(held["expires_at"]) <= timerValues.getCurrentWatermarkInMs()
        self._keep(held[~over])
        if over.any():
            ended = held[over]
            yield self._rows(ended.assign(ended_at=ended["expires_at"], how="expired"))

    def close(self) -> None:
        pass

    def _keep(self, live: pd.DataFrame) -> None:
        buckets.keep(self.live, live, _LIVE)
        buckets.wake(self.handle, buckets.milliseconds(live["expires_at"].astype(np.int64)))

    @staticmethod
    def _rows(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[_COLUMNS].astype({"user_id": "Int64", "expires_at": "int64", "ended_at": "Int64"})


def lives(events: DataFrame, hours: int = 24, late: str = "0 seconds") -> DataFrame:
    """Changes of sessions in a stream (token_hash, user_id, action, at): opened, closed by a later action, or expired after ``hours``.

    A token that is open stays as it is when it is opened again; closing an unknown or ended one does nothing.
    """
    rows = events.withWatermark("at", late).select(buckets.of("token_hash"), "token_hash", "user_id", "action", F.unix_micros("at").alias("at"), F.col("at").alias("_time"))
    return rows.groupBy("bucket").transformWithStateInPandas(Sessions(hours * 3_600_000_000), OUT, "update", "EventTime")


def current(changes: DataFrame) -> DataFrame:
    """One row for each session from the changes that were written; live ones have not ended."""
    last = changes.groupBy("token_hash").agg(F.max(F.struct(F.col("how") != "opened", "user_id", "expires_at", "ended_at", "how")).alias("s"))
    at = lambda c: F.timestamp_micros(F.col(c))
    return last.select("token_hash", "s.user_id", at("s.expires_at").alias("expires_at"), at("s.ended_at").alias("ended_at"), F.when(F.col("s.how") == "opened", "live").otherwise(F.col("s.how")).alias("how"))

"""Keyed state in buckets: the keys of a bucket are one frame, which is read, changed and written once in a batch.

A state for each key costs some milliseconds of messages between Spark and Python for each key and batch; here they are paid for
each bucket.  The number of buckets is part of a checkpoint: the same one has to be used after a restart.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, ValueState

#: What the state of a bucket is: its frame as an Arrow stream, and how many rows that has.
STATE, BUCKETS = "n long, frame binary", 256


def of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def load(state: ValueState, kinds: Mapping[str, str]) -> pd.DataFrame:
    """The rows of a bucket; ``kinds`` are the columns with their pandas types."""
    if not state.exists():
        return pd.DataFrame({c: pd.Series([], dtype=kind) for c, kind in kinds.items()})
    with pa.ipc.open_stream(bytes(state.get()[1])) as stream:
        table = stream.read_all()
    return pd.DataFrame({c: pd.Series(table[c].to_pylist(), dtype=kind) for c, kind in kinds.items()})


def keep(state: ValueState, rows: pd.DataFrame, kinds: Mapping[str, str]) -> None:
    """Write the rows of a bucket; a bucket without rows has no state."""
    if not len(rows):
        state.clear()
        return
    table = pa.table({c: pa.Array.from_pandas(rows[c], type=pa.string() if kind == "object" else pa.bool_() if kind == "bool" else pa.int64()) for c, kind in kinds.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    state.update((len(rows), sink.getvalue().to_pybytes()))


def milliseconds(micros: pd.Series) -> pd.Series:
    """The first millisecond that is not before a time in microseconds."""
    return -(-micros // 1000)


def wake(handle: StatefulProcessorHandle, due: pd.Series) -> None:
    """One timer for the bucket, at the first of the times ``due``; none without any."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if len(due):
        handle.registerTimer(int(np.min(due)))

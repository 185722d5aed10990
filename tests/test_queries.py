"""Every query with SQL gives the rows that DuckDB gives on the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from skein import queries as core

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_catalogue_is_complete():
    assert {"vector_topk", "sliding_chunks", "glob_exclude", "queue_resolve", "memory_metadata"} <= set(core.QUERIES)
    assert set(core.ORACLE) <= set(core.QUERIES)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_as_sql(spark, duck, name):
    ours, theirs = core.QUERIES[name](spark, SF).toPandas(), duck.sql(core.ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def rows(frame):
        return frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).sort_values(columns).to_numpy().tolist()

    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_gives_rows(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0

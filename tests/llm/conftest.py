from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and columns that clash."""
    words = " ".join(f"wörd{i % 97} the{i % 13}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, words, "en", "a", len(words)), (5, "the cat sat on the mat and slept", "en", None, 31),
        (6, "the cat sat on the mat and slept", "en", "b", 31), (7, "the cat sat on the mat and slept", None, "b", 31), (7, "the cat sat on the mat and slept", None, "b", 31),
        (8, "123 456", "de", "b", 7), (9, "der Hund und die Katze sind im Haus", "de", "b", 35), (None, "no number here at all today", "en", "c", 27), (10, "日本語 😀 é", "en", "c", 8), (11, words, "en", "a", len(words)),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("_block", "_row", "node", "bucket", "rank", "digest", "held_out_x", "set", "n_bytes", "n_removed", "letter", "_lost_id", "_dedup", "component_id", "kept", "range", "next", "hash", "share", "n", "count"):
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

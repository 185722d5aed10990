"""Overlapping text windows from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding_chunks(files: DataFrame, chunk_size: int = 400, overlap: int = 50, content: str = "content", gapless: bool = False) -> DataFrame:
    """One row for each window of ``content``: chunk_index, start, chunk.

    Windows of ``4 * chunk_size`` characters begin every ``4 * (chunk_size - overlap)``; one that is not at the end of the
    text is cut at its last line feed (not at one in its first place).  Text between such a cut and the next window is
    in no chunk; ``gapless`` keeps the window whole instead.
    """
    if chunk_size <= 0 or overlap < 0 or overlap >= chunk_size:
        raise ValueError("the overlap must be at least 0 and smaller than the chunk size")
    window, step = 4 * chunk_size, 4 * (chunk_size - overlap)
    n = F.length(content)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    return cut_windows(files.select("*", F.posexplode(starts).alias("chunk_index", "start")), window, content, gapless)


def cut_windows(rows: DataFrame, window: int, content: str = "content", gapless: bool = False) -> DataFrame:
    """``rows`` (content, start) with the chunk of ``window`` characters from there, cut at its last line feed."""
    piece = F.substring(F.col(content), F.col("start") + 1, F.lit(window))
    tail = F.col("start") + window >= F.length(content)
    back = F.instr(F.reverse(F.col("piece")), "\n")
    cut = F.length("piece") - back
    kept = F.col("piece") if gapless else F.when(tail | (back == 0) | (cut <= 0), F.col("piece")).otherwise(F.left("piece", cut.cast("int")))
    return rows.withColumn("piece", piece).withColumn("chunk", kept).drop("piece")


def metadata(name: Column, start_line: Column) -> Column:
    """The chunk metadata as JSON; a missing name stays as null."""
    return F.to_json(F.struct(name.alias("name"), start_line.alias("start_line")), {"ignoreNullFields": "false"})


def text_metadata() -> Column:
    return F.to_json(F.struct(F.lit(0).alias("start_line")))

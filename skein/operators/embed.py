"""Embedding text with any client, in batches, with adaptive retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, LONGEST, ATTEMPTS, LONGEST_WAIT = 20, 8000, 5, 30
#: What tells a rate limit in a client's message.
RATE_SIGNS = ("429", "rate limit", "rate_token_limit_exceeded")
Client = Callable[[list[str]], list[list[float]]]


def limited(error: Exception) -> bool:
    return any(sign in str(error).lower() for sign in RATE_SIGNS)


def embed_batch(texts: list[str], client: Client, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors in input order: a rate-limited batch is halved, a single text waits 1, 2, 4, … seconds, others raise.

    A stack holds the parts still to do, the next one on top, each with the number of its refusals.
    """
    done: list[list[float]] = []
    parts = [(texts, 0)]
    while parts:
        part, refused = parts.pop()
        try:
            done += client(part)
            continue
        except Exception as error:
            if not limited(error) or (len(part) == 1 and refused + 1 >= ATTEMPTS):
                raise
        if len(part) == 1:
            sleep(min(2**refused, LONGEST_WAIT))
            parts.append((part, refused + 1))
        else:
            middle = len(part) // 2
            parts += [(part[middle:], 0), (part[:middle], 0)]
    return done


def embed_all(texts: Sequence[str], client: Client, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """All vectors, in batches of ``BATCH``."""
    out: list[list[float]] = []
    for lo in range(0, len(texts), BATCH):
        out += embed_batch([t[:LONGEST] for t in texts[lo : lo + BATCH]], client, sleep)
    return out


def hashing_client(dims: int = 64) -> Client:
    """Deterministic vectors: counts of words in hashed places with hashed signs, of length one."""
    import hashlib
    import re
    from functools import lru_cache

    @lru_cache(maxsize=1 << 16)
    def place(word: str) -> int:
        """The place of a word, and ``dims`` more where its sign is positive."""
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h % dims + dims * (h >> 63)

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            counts = np.bincount([place(word) for word in re.findall(r"\w+", text.lower())] or [0, dims], minlength=2 * dims)
            row += counts[dims:] - counts[:dims]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return run


def with_embeddings(chunks: DataFrame, make_client: Callable[[], Client], content: str = "content") -> DataFrame:
    """``chunks`` with an embedding; a client is made once for each task."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            frame["embedding"] = embed_all(frame[content].fillna("").tolist(), client)
            yield frame

    return chunks.mapInPandas(run, schema)


def hashed_columns(texts: DataFrame, key: str, content: str, dims: int = 16) -> DataFrame:
    """(key, embedding) by built-in expressions only: words counted in places given by their MD5; without a word all are 0."""
    words = texts.select(key, F.explode_outer(F.filter(F.split(F.lower(content), r"\s+"), lambda w: w != "")).alias("word"))
    place = F.conv(F.substring(F.md5("word"), 1, 2), 16, 10).cast("int") % dims
    counts = words.groupBy(key, place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "n")))).alias("m"))
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)).cast("double")).alias("embedding"))

"""An inverted file of vectors: every row lies in the partition of its nearest centroid, and a search reads the nearest lists.

``path/rows`` is partitioned by ``list``, ``path/centroids`` has a row for each list, ``path/schema`` the columns.  Centroids are fitted on a bounded
sample, every row is assigned.  Rows without a direction (null or zero vectors, or another number of components) lie in
list -1, which only a search of all lists reads: they have no similarity and come last there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import search

#: Lists, rows of the sample for each of them, and rounds of fitting.
LISTS, SAMPLE_PER_LIST, ROUNDS = 100, 256, 12
#: Rows and queries that meet in one group of a batch search; queries that are compared with all rows to choose the number of lists.
GROUP_ROWS, GROUP_QUERIES, TUNING_QUERIES = 1 << 14, 1 << 12, 64
#: The list of rows without a direction.
NOWHERE = -1


def directions(vectors: Sequence, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of those that have a direction in ``dims`` components."""
    kept, out = [], []
    for place, v in enumerate(vectors):
        v = None if v is None or len(v) != dims else np.asarray(v, np.float64)
        norm = 0.0 if v is None else np.sqrt(v @ v)
        if norm > 0 and np.isfinite(norm):
            kept.append(place)
            out.append(v / norm)
    return np.array(kept, np.int64), np.stack(out) if out else np.zeros((0, dims))


def fit(rows: DataFrame, lists: int = LISTS, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Unit centroids by spherical k-means, on at most ``SAMPLE_PER_LIST`` rows for each list, those of the smallest hashes."""
    if lists < 1:
        raise ValueError("there has to be a list")
    sample = rows.filter(F.size(vector) > 0).select(key, vector).orderBy(F.xxhash64(key), key).limit(SAMPLE_PER_LIST * lists).toPandas()[vector].tolist()
    if not sample:
        return np.zeros((0, 0))
    dims = int(np.bincount([len(v) for v in sample]).argmax())
    x = np.unique(directions(sample, dims)[1], axis=0)
    if not len(x):
        return np.zeros((0, dims))
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def assign(vector: Column, centres: np.ndarray) -> Column:
    """The list of a vector."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), NOWHERE, np.int32)
        places, x = directions(vectors, centres.shape[1])
        if len(centres) and len(x):
            out[places] = (x @ centres.T).argmax(axis=1)
        return pd.Series(out)

    return nearest(vector)


def _probes(centres: np.ndarray, probes: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(query_id, query, list) of the nearest lists of each query."""
    for frame in frames:
        places, x = directions(frame["query"], centres.shape[1])
        near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
        rows = frame.iloc[np.repeat(places, near.shape[1])]
        yield pd.DataFrame({"query_id": rows["query_id"].to_numpy(), "query": rows["query"].to_numpy(), "list": near.ravel().astype(np.int32)})


def _nearest(k: int, key: str, vector: str, group: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The k nearest rows of each query of one group, by one matrix product."""
    out = pd.DataFrame({"query_id": [], key: [], "similarity": [], "list": []})
    if not len(rows) or not len(queries):
        return out
    # Sorted, so that equal similarities go by the key.
    rows = rows.sort_values(key)
    dims = len(queries["query"].iloc[0])
    asked, q = directions(queries["query"], dims)
    places, x = directions(rows[vector], dims)
    if not len(x) or not len(q):
        return out
    score = q @ x.T
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    of = np.repeat(np.arange(len(q)), best.shape[1])
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[asked[of]], key: rows[key].to_numpy()[places[best.ravel()]], "similarity": score[of, best.ravel()], "list": group[0]})


class InvertedFile:
    """An inverted file that was built at ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
        self.spark, self.path, self.key, self.vector = spark, path, key, vector

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int = LISTS, key: str = "vec_id", vector: str = "embedding") -> InvertedFile:
        """Fit the lists on a sample and write every row into the partition of its list; long lists are split among tasks."""
        spark, centres = rows.sparkSession, fit(rows, lists, key, vector)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        dealt = rows.withColumn("list", assign(F.col(vector), centres)).hint("rebalance", "list")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("list").parquet(f"{path}/rows")
        dealt.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # a table without rows has no file to tell it
        return cls(spark, path, key, vector)

    @cached_property
    def centres(self) -> np.ndarray:
        """One row for each list; as many as were asked for at building."""
        found = [r["centre"] for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()]
        return np.array(found) if found else np.zeros((0, 0))

    @cached_property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")

    def lists(self, query: Sequence[float], probes: int) -> list[int]:
        """The nearest lists of a query, the nearest first."""
        _, x = directions([query], self.centres.shape[1])
        return np.argsort(-(x @ self.centres.T)[0], kind="stable")[:probes].tolist() if len(x) else []

    def search(self, query: Sequence[float] | None, k: int = 10, probes: int | None = None, repos: Sequence[str] | None = None) -> DataFrame:
        """The k rows most similar to a vector among its nearest lists; without ``probes`` among all rows, which is exact.

        The other lists are partitions that the scan leaves out.
        """
        rows = self.rows
        if probes is not None and query is not None:
            rows = rows.filter(F.col("list").isin(self.lists(query, probes)))
        return search.top_k(rows, query, k, repos, keys=(self.key,), vector=self.vector).drop("list")

    def search_batch(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, rank, key, similarity, list) of the k nearest rows of each query (query_id, query) in its nearest lists.

        Rows and queries of a list meet in groups of bounded size, each a matrix product; rows and queries without a
        direction have no similarity and are left out.
        """
        schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("query", queries.schema["query"].dataType), T.StructField("list", T.IntegerType())])
        asked = queries.select("query_id", "query").mapInPandas(partial(_probes, self.centres, probes or len(self.centres)), schema)
        rows = self.rows.select(self.key, self.vector, "list").filter(F.col("list") != NOWHERE)
        # At most one row for each list.
        parts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("row_parts")).join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).alias("query_parts")), "list")

        def dealt(d: DataFrame, own: str, by: str, other: str) -> DataFrame:
            each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1))
            return d.join(F.broadcast(parts), "list").withColumn(f"{own}_part", F.pmod(F.xxhash64(by), F.col(f"{own}_parts"))).withColumn(f"{other}_part", each).drop("row_parts", "query_parts")

        keys = ["list", "row_part", "query_part"]
        out = T.StructType([schema["query_id"], self.rows.schema[self.key], T.StructField("similarity", T.DoubleType()), T.StructField("list", T.IntegerType())])
        kernel = partial(_nearest, k, self.key, self.vector)

        def nearest(group: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            return kernel(group, r, q)

        near = dealt(rows, "row", self.key, "query").groupBy(*keys).cogroup(dealt(asked, "query", "query_id", "row").groupBy(*keys)).applyInPandas(nearest, out)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), self.key))
        return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", self.key, "similarity", "list")

    def tune(self, queries: DataFrame, k: int = 10, target: float = 0.95) -> int:
        """How many lists hold the share ``target`` of the k nearest rows of a bounded sample of ``queries``, each compared with all rows."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNING_QUERIES)
        vectors = {r["query_id"]: r["query"] for r in some.collect()}
        place = {q: {n: i for i, n in enumerate(self.lists(v, len(self.centres)))} for q, v in vectors.items()}
        true = self.search_batch(some, k).select("query_id", "list").collect()  # k for each query of the sample
        ranks = np.sort([place[r["query_id"]][r["list"]] for r in true])
        return int(ranks[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else max(1, len(self.centres))


def recall(exact: DataFrame, found: DataFrame, key: str = "vec_id") -> DataFrame:
    """(queries, recall): the share of the exact results that were found; null without any."""
    both = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

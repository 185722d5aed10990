"""Approximate nearest neighbours by multi-index hashing: binary codes in substrings, pigeonhole probes, a float ranking.

Vectors become 64-bit codes by rotations learned on a bounded sample (iterative quantisation).  Each shard of the index holds
the codes, the vectors, and for each of the eight bytes of a code the rows in order of that byte.  Two codes within a
radius agree, in one byte at least, to within the share of the radius that falls to it, so that probing the bytes near
the query's retrieves every code within the radius; all of them are ranked by their cosine.  The radius is the one that
holds ``COVERED`` of the true neighbours of a bounded sample of queries, found by comparing these with all rows.
Queries that find too few vectors so are searched again within the radius 64, which holds every code.

Equal vectors are one class in the index: a class needs no more ids than a result can show.

Defined results: vectors that are null, zero or hold a null or a component that is not finite take no part, nor do rows
without an id and vectors that have not the most frequent number of components (of several, the largest).  Rows with the
same id and vector count once; a query whose id has several vectors takes the least of them and none of its own as a result.
An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage

#: Vectors from which the rotations are learned, and queries from which the radius is, at most.
SAMPLE_ROWS, SAMPLE_QUERIES = 16_384, 128
#: The share of true neighbours that the radius holds in the sample.
COVERED = 0.98
#: Vectors of one shard, queries that are broadcast together, pairs that a step of the search holds.
SHARD_ROWS, BLOCK_QUERIES, HELD = 1 << 14, 1 << 14, 1 << 20
BYTES, BITS = 8, 64
#: The distance of two bytes.
_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col("vector")
    there = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(there)
    size = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "size"))["size"]).first()[0]
    return rows.filter(F.size("vector") == F.lit(size))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """(h1, h2, vector, ids) of the distinct vectors of ``rows`` (id, vector), with the smallest ``ids`` ids of each.

    A vector is told by 128 bits of two hashes.  Vectors are shuffled once, after one of each class and task is kept.
    """
    plain = F.transform("vector", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    keyed = rows.select("id", "vector", F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain, F.lit(1)).alias("h2"))
    narrow = keyed.select("h1", "h2", "id").distinct()
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    few = narrow.withColumn("nth", nth).filter(F.col("nth") <= ids).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return keyed.groupBy("h1", "h2").agg(F.first("vector").alias("vector")).join(few, ["h1", "h2"])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; powers of two keep large and small ones from overflow."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotations(sample: np.ndarray, bits: int = BITS, rounds: int = 30) -> np.ndarray:
    """(components, bits): directions whose signs are the code.

    Each block of as many bits as there are components is a rotation of the principal directions that brings the
    sample near to the corners of a cube; further blocks start from other rotations.
    """
    rng = np.random.default_rng(0)
    x = unit(sample)
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x)
    blocks = []
    while sum(b.shape[1] for b in blocks) < bits:
        width = min(d, bits)
        w = axes[:, ::-1][:, :width]
        y = x @ w
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        blocks.append(w @ turn)
    return np.concatenate(blocks, axis=1)[:, :bits]


def encode(rows: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """The codes of rows, eight bytes each."""
    # Not by a matrix product, whose last bits may depend on where a row stands.
    side = np.stack([np.einsum("ij,j->i", rows, r) for r in np.ascontiguousarray(rotations.T)], axis=1) >= 0
    return np.packbits(side, axis=1)


SHARD = "codes binary, vectors binary, starts binary, places binary, ids array<array<long>>"


def _build_shards(rotations: np.ndarray, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards of the classes of one partition."""

    def shard(vectors: list, ids: list) -> pd.DataFrame:
        x = unit(np.stack(vectors).astype(np.float64))
        codes = encode(x, rotations)
        places = np.stack([np.argsort(codes[:, j], kind="stable") for j in range(BYTES)]).astype(np.int32)
        starts = np.stack([np.searchsorted(codes[places[j], j], np.arange(257)) for j in range(BYTES)]).astype(np.int32)
        row = (codes.tobytes(), x.tobytes(), starts.tobytes(), places.tobytes(), [list(map(int, i)) for i in ids])
        return pd.DataFrame([row], columns=["codes", "vectors", "starts", "places", "ids"])

    vectors: list = []
    ids: list = []
    for frame in frames:
        for vector, own in zip(frame["vector"], frame["ids"], strict=True):
            vectors.append(vector)
            ids.append(own)
            if len(vectors) == SHARD_ROWS:
                yield shard(vectors, ids)
                vectors, ids = [], []
    if vectors:
        yield shard(vectors, ids)


def shares(radius: int) -> list[int]:
    """The radius of each byte: codes within ``radius`` are within it in one byte at least; -1 is none."""
    whole, more = divmod(radius, BYTES)
    return [whole] * (more + 1) + [whole - 1] * (BYTES - more - 1)


class Shard:
    """A shard as a task uses it."""

    def __init__(self, row: dict) -> None:
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, BYTES)
        n = len(self.codes)
        self.vectors = np.frombuffer(row["vectors"]).reshape(n, -1)
        self.starts = np.frombuffer(row["starts"], np.int32).reshape(BYTES, 257)
        self.places = np.frombuffer(row["places"], np.int32).reshape(BYTES, n)
        self.ids = row["ids"]

    def within(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row): every row whose code is within ``radius`` of a query's, each once."""
        own, theirs = self.codes.view(np.uint64)[:, 0], np.ascontiguousarray(codes).view(np.uint64)[:, 0]
        share = shares(radius)
        query, rows = [], []
        for j, r in enumerate(share):
            if r < 0:
                continue
            near = _APART[codes[:, j]] <= r
            of, byte = np.nonzero(near)
            lo = self.starts[j][byte]
            many = self.starts[j][byte + 1] - lo
            cut = np.searchsorted(np.cumsum(many), np.arange(HELD, int(many.sum()) + HELD, HELD))  # probes whose rows fit into a step
            for a, b in zip(np.concatenate(([0], cut[:-1] + 1)), np.minimum(cut + 1, len(many)), strict=True):
                m = many[a:b]
                q = np.repeat(of[a:b], m)
                at = self.places[j][np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[a:b], m)]
                good = np.bitwise_count(own[at] ^ theirs[q]) <= radius
                q, at = q[good], at[good]
                # A pair that an earlier byte retrieves as well is left to that one.
                first = np.ones(len(q), bool)
                for i in range(j):
                    first &= _APART[codes[q, i], self.codes[at, i]] > share[i]
                query.append(q[first])
                rows.append(at[first])
        return np.concatenate(query), np.concatenate(rows)

    def best(self, vectors: np.ndarray, query: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """For each query with rows: its ``k`` nearest ids, by the cosine and then the id."""
        order = np.argsort(query, kind="stable")
        query, rows = query[order], rows[order]
        for part in np.split(np.arange(len(query)), np.flatnonzero(np.diff(query)) + 1):
            if not len(part):
                continue
            at = rows[part]
            score = np.einsum("ij,j->i", self.vectors[at], vectors[query[part[0]]])
            if len(at) > k:  # all that may tie with the k-th stay
                keep = score >= np.partition(score, -k)[-k]
                at, score = at[keep], score[keep]
            found = sorted((-s, i) for s, r in zip(score.tolist(), at.tolist(), strict=True) for i in self.ids[r])[:k]
            yield int(query[part[0]]), [(-s, i) for s, i in found]


FOUND = "h1 long, h2 long, score double, id long"


def _search(queries: Broadcast, radius: int, k: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ``k`` nearest ids of each query in each shard."""
    h1, h2, vectors, codes = queries.value
    for frame in frames:
        for row in frame.to_dict("records"):
            shard = Shard(row)
            step = max(1, 4 * HELD // max(1, len(shard.codes)))
            for lo in range(0, len(codes), step):
                query, rows = shard.within(codes[lo : lo + step], radius)
                out = [(h1[lo + q], h2[lo + q], s, i) for q, best in shard.best(vectors[lo : lo + step], query, rows, k) for s, i in best]
                if out:
                    yield pd.DataFrame(out, columns=["h1", "h2", "score", "id"])


def _exact(queries: Broadcast, k: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(q, score, apart): the ``k`` nearest of each sampled query in each shard, by comparing all, with the distance of the codes."""
    vectors, codes = queries.value
    for frame in frames:
        for row in frame.to_dict("records"):
            shard = Shard(row)
            score = vectors @ shard.vectors.T
            near = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(vectors)), near.shape[1])
            apart = np.bitwise_count(codes[q] ^ shard.codes[near.ravel()]).sum(axis=1)
            yield pd.DataFrame({"q": q, "score": score[q, near.ravel()], "apart": apart.astype(np.int64)})


class MultiIndex:
    """An index of ``vectors``; ``search`` finds the nearest of those ids that a condition chooses.

    ``recall`` is not promised: ``radius`` is chosen so that ``COVERED`` of a sample's true neighbours are retrieved.
    """

    def __init__(self, vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> None:
        if k < 1:
            raise ValueError("k has to be positive")
        self.spark, self.k = vectors.sparkSession, k
        self.rows = usable(vectors, key, vector)
        self.classes = stage(classes(self.rows, k + 1), "classes")
        some = self.classes.orderBy(F.xxhash64("h1"), "h2").select("h1", "h2", "vector").limit(SAMPLE_ROWS).toPandas()
        self.empty = not len(some)
        if self.empty:
            return
        sample = np.stack(some["vector"]).astype(np.float64)
        self.rotations = learn_rotations(sample)
        self.shards = stage(self.classes.select("vector", "ids").mapInPandas(partial(_build_shards, self.rotations), SHARD), "shards")
        self.radius = self._radius(unit(sample[:SAMPLE_QUERIES]))

    def _radius(self, queries: np.ndarray) -> int:
        """The distance that holds ``COVERED`` of the k nearest others of the sampled queries."""
        shared = self.spark.sparkContext.broadcast((queries, encode(queries, self.rotations)))
        near = stage(self.shards.mapInPandas(partial(_exact, shared, self.k + 1), "q long, score double, apart long"), "near")
        shared.destroy()
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))  # the first is the query itself
        apart = near.withColumn("nth", nth).filter(F.col("nth").between(2, self.k + 1)).groupBy("apart").agg(F.count(F.lit(1)).alias("n")).orderBy("apart").collect()  # 65 rows at most
        if not apart:
            return BITS
        passed = np.cumsum([r["n"] for r in apart])
        return int(apart[int(np.searchsorted(passed, COVERED * passed[-1]))]["apart"])

    def _found(self, queries: DataFrame, radius: int) -> DataFrame:
        """(h1, h2, near) of the query classes that find anything, ``near`` their k + 1 nearest (score, id); queries go in blocks."""
        blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks)))
        parts = []
        for block in range(blocks):
            some = dealt.filter(F.col("block") == block).select("h1", "h2", "vector").toPandas()
            if not len(some):
                continue
            x = unit(np.stack(some["vector"]).astype(np.float64))
            shared = self.spark.sparkContext.broadcast((some["h1"].to_numpy(), some["h2"].to_numpy(), x, encode(x, self.rotations)))
            parts.append(stage(self.shards.mapInPandas(partial(_search, shared, radius, self.k + 1), FOUND), "found"))
            shared.destroy()
        if not parts:
            return self.spark.createDataFrame([], "h1 long, h2 long, near array<struct<score:double,id:long>>")
        found = parts[0]
        for more in parts[1:]:
            found = found.union(more)
        nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id"))
        top = found.withColumn("nth", nth).filter(F.col("nth") <= self.k + 1)
        near = F.transform(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id")))
        return top.groupBy("h1", "h2").agg(near.alias("near"))

    def search(self, chosen: Column) -> DataFrame:
        """(query_id, rank, id, score): the k nearest found of each id for which ``chosen``, a condition on ``id``, holds."""
        if self.empty:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, score double")
        plain = F.transform("vector", lambda x: x + F.lit(0.0))
        asked = self.rows.filter(chosen).groupBy("id").agg(F.min("vector").alias("vector")).select("id", "vector", F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain, F.lit(1)).alias("h2"))
        asked = stage(asked, "queries")
        kinds = asked.groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
        found = stage(self._found(kinds, self.radius), "nearest")
        full = found.filter(F.size("near") > self.k)
        few = kinds.join(full, ["h1", "h2"], "left_anti")  # within the radius are too few: every code is retrieved
        found = full if self.radius == BITS and few.isEmpty() else full.union(self._found(few, BITS))
        own = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, self.k)
        rows = asked.select("id", "h1", "h2").join(found, ["h1", "h2"]).select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "x"))
        return rows.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def nearest(vectors: DataFrame, chosen: Column, k: int = 5) -> DataFrame:
    """The k nearest of the chosen ids among ``vectors`` (vec_id, embedding), as (query_id, rank, vec_id, score)."""
    return MultiIndex(vectors, k).search(chosen).withColumnRenamed("id", "vec_id")

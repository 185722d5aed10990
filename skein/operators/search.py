"""Nearest chunks, similar groups and their views."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors

#: So many queries are broadcast at most, or meet the rows in one task; pairs that a task reads before it drops the far ones.
BLOCK_QUERIES, HELD_PAIRS = 4096, 1 << 17
#: Rows and queries that meet in one matrix product; by how much it may differ from a similarity; squared lengths whose products are numbers.
GROUP_ROWS, GROUP_QUERIES, SLACK, LENGTHS = 1 << 13, 1 << 10, 1e-9, (1e-140, 1e140)


def in_repos(column: Column, repos: Sequence[str] | None) -> Column:
    """Membership; no repositories mean no filter."""
    return column.isin(*repos) if repos else F.lit(True)


def top_k(chunks: DataFrame, query: Sequence[float] | None, k: int = 10, repos: Sequence[str] | None = None, keys: Sequence[str] = ("vec_id",), vector: str = "embedding", exact: bool = False) -> DataFrame:
    """The k rows most similar to a vector, with score to four places; rows without a similarity come last, and no vector finds none.

    Only keys and similarity are sorted; the winners' other columns are joined back.  ``exact`` keeps the similarity.
    """
    if k <= 0:
        raise ValueError("k has to be positive")
    found = chunks.filter(in_repos(F.col("repo_name"), repos))
    if query is None:
        return found.limit(0).withColumn("score", F.lit(None).cast("double")).drop(vector).select("*", *[F.col("score").alias("similarity")] * exact)
    sim = vectors.cosine_to(F.col(vector), query)
    order = [F.desc_nulls_last("similarity"), *keys]
    narrow = set(found.columns) <= {*keys, "repo_name", vector}
    ranked = found.select(*([c for c in found.columns if c != vector] if narrow else keys), sim.alias("similarity")).orderBy(*order).limit(k)
    if not narrow:
        # Where keys repeat, the similarity tells the winners; what still ties is cut by the second ranking.
        best = ranked.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
        wide = found.join(F.broadcast(best), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left_semi")
        ranked = wide.withColumn("similarity", sim).orderBy(*order).limit(k)
    return ranked.withColumn("score", F.round("similarity", 4)).select(*[c for c in found.columns if c != vector], "score", *["similarity"] * exact)


def _first_k(k: int, key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first k pairs of each query in one task, in the order of top_k_batch; only these are held."""
    order = [("query", "ascending"), ("kind", "ascending"), ("similarity", "descending"), ("absent", "descending"), (key, "ascending")]

    def cut(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).combine_chunks()
        query = pc.fill_null(table["query_id"].combine_chunks().dictionary_encode().indices, -1)
        # As Spark sorts: NaN before the numbers, null similarities last, null keys first.
        kind = pc.fill_null(pc.if_else(pc.is_nan(table["similarity"]), 0, 1), 2)
        at = pc.sort_indices(pa.table([query, kind, table["similarity"], pc.is_null(table[key]).cast(pa.int8()), table[key]], ["query", "kind", "similarity", "absent", key]), sort_keys=order)
        run = query.take(at).to_numpy()
        first = np.concatenate(([True], run[1:] != run[:-1]))[: len(run)]
        place = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
        return table.take(at.filter(pa.array(place < k)))

    parts, rows = [], 0
    for batch in batches:
        parts.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= HELD_PAIRS:
            parts, rows = [cut(parts)], 0
    if parts:
        yield from cut(parts).to_batches()


def _nearest(k: int, key: str, vector: str, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """(query_id, key, similarity) of the k nearest rows of each query of one group of rows and queries that have a direction.

    One matrix product finds who can be among them; their similarity is then summed in the order that ``vectors.cosine`` has, so that
    equal vectors tie.
    """
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": queries["query_id"], key: rows[key], "similarity": np.zeros(0)}).iloc[:0]
    rows = rows.sort_values(key, ignore_index=True)
    # Of rows with one vector only those of the k smallest keys can be near to anything.
    same = pd.Series([v.tobytes() for v in rows[vector]])
    rows = rows[same.groupby(same, sort=False).cumcount() < k]
    x, q = (np.stack(c.to_list()).astype(np.float64) for c in (rows[vector], queries["query"]))

    def summed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(len(i))
        for d in range(a.shape[1]):
            total += a[i, d] * b[j, d]
        return total

    xx, qq = (summed(m, m, np.arange(len(m)), np.arange(len(m))) for m in (x, q))
    near = (q / np.sqrt(qq)[:, None]) @ (x / np.sqrt(xx)[:, None]).T
    least = np.partition(near, -k, axis=1)[:, -k] if k < len(x) else np.full(len(q), -2.0)
    of, row = np.nonzero(near >= (least - SLACK)[:, None])
    exact = summed(q, x, of, row) / np.sqrt(qq[of] * xx[row])
    at = np.lexsort((row, -exact, of))
    of, row, exact = of[at], row[at], exact[at]
    at = np.arange(len(of)) - np.searchsorted(of, of) < k
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[of[at]], key: rows[key].to_numpy()[row[at]], "similarity": exact[at]})


def top_k_batch(chunks: DataFrame, queries: DataFrame, k: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows of a stated set of queries (query_id, query).

    Rows and queries with a direction meet in groups of bounded size, each a matrix product, which hands on the k nearest rows of
    each of its queries only.  The others (null or zero vectors, components that are null or not finite, other lengths) are few
    and are compared pair by pair; of equal ones among the rows the k first count, as no query tells them apart.
    """
    sizes = queries.groupBy(F.size("query").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).collect()  # a row for each length
    dims, n, rows = sizes[0]["dims"] if sizes else 0, sum(r["n"] for r in sizes), chunks.select(key, vector)

    def plain(name: str, of: Column) -> Column:
        finite = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        return F.coalesce(of.isNotNull() & (F.size(name) == dims) & finite & vectors.dot(F.col(name), F.col(name)).between(*LENGTHS), F.lit(False))

    good, asked = rows.filter(plain(vector, F.col(key))), queries.select("query_id", "query").filter(plain("query", F.col("query_id")))
    odd, rest = rows.filter(~plain(vector, F.col(key))), queries.select("query_id", "query").filter(~plain("query", F.col("query_id")))
    odd = odd.withColumn("_copy", F.row_number().over(Window.partitionBy(vector).orderBy(key))).filter(F.col("_copy") <= k).drop("_copy")

    def compared(some: DataFrame, by: DataFrame) -> DataFrame:
        side = F.broadcast(by) if n <= BLOCK_QUERIES else by.repartition(-(-n // BLOCK_QUERIES)).hint("shuffle_replicate_nl")
        pairs = some.crossJoin(side).select("query_id", key, vectors.cosine(F.col(vector), F.col("query")).alias("similarity"))
        return pairs.mapInArrow(partial(_first_k, k, key), pairs.schema)

    row_parts, query_parts = (max(1, -(-m // size)) for m, size in ((chunks.count(), GROUP_ROWS), (n, GROUP_QUERIES)))

    def dealt(d: DataFrame, by: str, own: str, parts: int, other: str, others: int) -> GroupedData:
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return d.withColumn(own, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).withColumn(other, each).groupBy("_row_part", "_query_part")

    kernel, schema = partial(_nearest, k, key, vector), T.StructType([queries.schema["query_id"], rows.schema[key], T.StructField("similarity", T.DoubleType())])

    def nearest(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return kernel(r, q)

    near = dealt(good, key, "_row_part", row_parts, "_query_part", query_parts).cogroup(dealt(asked, "query_id", "_query_part", query_parts, "_row_part", row_parts)).applyInPandas(nearest, schema)
    near = near.union(compared(odd, asked)).union(compared(good.union(odd), rest))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), key)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", key, F.round("similarity", 4).alias("score"))


def relationships(chunks: DataFrame, limit: int = 20, repo: str | None = None, vector: str = "embedding") -> DataFrame:
    """(repo_a, repo_b, similarity, chunks_a, chunks_b) of group means, most similar first; each pair once."""
    means = vectors.mean_vectors(chunks, "repo_name", vector)
    a = means.select(F.col("repo_name").alias("repo_a"), F.col("mean").alias("mean_a"), F.col("n").alias("chunks_a"))
    b = means.select(F.col("repo_name").alias("repo_b"), F.col("mean").alias("mean_b"), F.col("n").alias("chunks_b"))
    pairs = a.join(b, F.col("repo_a") < F.col("repo_b"))
    if repo is not None:
        pairs = pairs.filter((F.col("repo_a") == repo) | (F.col("repo_b") == repo))
    out = pairs.select("repo_a", "repo_b", F.round(vectors.cosine(F.col("mean_a"), F.col("mean_b")), 4).alias("similarity"), "chunks_a", "chunks_b")
    return out.orderBy(F.desc_nulls_last("similarity"), "repo_a", "repo_b").limit(limit)


def group_results(results: DataFrame, per_group: int = 4) -> DataFrame:
    """Results (repo_name, score, similarity, vec_id) in groups: largest group first, ties by the best similarity; the best few of each."""
    rank = F.row_number().over(Window.partitionBy("repo_name").orderBy(F.desc_nulls_last("similarity"), "vec_id"))
    size = F.count(F.lit(1)).over(Window.partitionBy("repo_name"))
    best = F.max("similarity").over(Window.partitionBy("repo_name"))
    grouped = results.withColumn("rank", rank).withColumn("group_size", size).withColumn("_best", best).filter(F.col("rank") <= per_group)
    return grouped.orderBy(F.desc("group_size"), F.desc_nulls_last("_best"), "repo_name", "rank").drop("_best", "similarity")


def related_edges(edges: DataFrame, results: DataFrame, limit: int = 10) -> DataFrame:
    """Edges with an end among the repositories of the results."""
    names = results.select(F.col("repo_name").alias("_repo")).distinct()
    ends = [edges.join(names, F.col(end) == F.col("_repo"), "left_semi") for end in ("repo_a", "repo_b")]
    kept = ends[0].union(ends[1]).distinct()
    return kept.orderBy(F.desc_nulls_last("similarity"), "repo_a", "repo_b").limit(limit)


def unified(words: str, groups: DataFrame, memories: DataFrame, jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, place, key, score): four result lists as one; blank words give none.

    Each list comes with (place, key, score) and keeps its own order.
    """
    parts = [d.select(F.lit(kind).alias("kind"), F.col("place").cast("int").alias("place"), "key", F.col("score").cast("double").alias("score")) for kind, d in (("repo", groups), ("memory", memories), ("job", jobs), ("edge", edges))]
    out = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return out if words.strip() else out.limit(0)


def decoded(results: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Results with their metadata as a variant: a JSON text is decoded, a broken or missing one is null."""
    return results.withColumn(metadata, F.try_parse_json(metadata))

"""Queries over the inverted file of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import ivf, scratch
from .queries import ORACLE, _V, _query_vector, query, store


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ivf.InvertedFile]:
    rows = store(spark, sf_dir, "vectors")
    return rows, ivf.InvertedFile.build(rows, f"{scratch.folder(spark)}/vectors")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("vector_index_exact", ORACLE["vector_topk"])
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists of the inverted file: the exact way."""
    rows, index = _index(spark, sf_dir)
    return index.search(_query_vector(rows), 10)


@query("vector_index_topk")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest lists only, as many as a sample of queries needs for 95 % of its neighbours."""
    rows, index = _index(spark, sf_dir)
    return index.search(_query_vector(rows), 10, index.tune(_asked(rows)))


@query(
    "vector_index_batch",
    f"""{_V} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(s, 4) AS score FROM (
      SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(b.e, a.e) AS s,
             row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(b.e, a.e) DESC, b.vec_id) AS rank
      FROM vectors a, vectors b WHERE a.vec_id % 100 = 0) WHERE rank <= 10""",
)
def vector_index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists, all queries: rows and queries of a list meet in matrix products."""
    rows, index = _index(spark, sf_dir)
    return index.search_batch(_asked(rows), 10).select("query_id", "rank", "vec_id", F.round("similarity", 4).alias("score"))


@query("vector_index_recall", f"{_V} SELECT count(*) AS queries, true AS reached FROM vectors WHERE vec_id % 100 = 0 HAVING count(*) > 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the search of the nearest lists finds nine tenths of what the exact search finds."""
    rows, index = _index(spark, sf_dir)
    asked = _asked(rows)
    return ivf.recall(index.search_batch(asked, 10), index.search_batch(asked, 10, index.tune(asked))).filter("queries > 0").select("queries", (F.col("recall") >= 0.9).alias("reached"))

"""The nearest rows of many queries against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import search


@pytest.mark.parametrize("block", [7, 1000])
def test_batch_in_blocks(spark, monkeypatch, block):
    """More queries than a block holds are not broadcast, and the order is the one of a plain sort."""
    monkeypatch.setattr(search, "BLOCK_QUERIES", block)
    monkeypatch.setattr(search, "HELD_PAIRS", 50)
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (62, [float("nan"), 1.0, 1.0])]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = chunks.filter("vec_id % 2 = 0 or vec_id = 61").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = search.top_k_batch(chunks, queries, 4)
    plan = got._jdf.queryExecution().toString()
    assert ("CartesianProduct" in plan) == (block == 7) and ("BroadcastNestedLoopJoin" in plan) == (block == 1000)
    plain = search.vectors.cosine(F.col("embedding"), F.col("query"))
    best = chunks.crossJoin(queries).select("query_id", F.struct(plain.alias("s"), "vec_id").alias("p")).groupBy("query_id").agg(F.collect_list("p").alias("ps"))
    expected = set()
    for q, ps in best.collect():
        first = sorted(ps, key=lambda p: (p.s is None, -(float("inf") if p.s is None or p.s != p.s else p.s), -1 if p.vec_id is None else p.vec_id))[:4]
        expected |= {(q, r, p.vec_id, str(None if p.s is None else round(p.s, 4))) for r, p in enumerate(first, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], str(r["score"])) for r in got.collect()} == expected and len(expected) == 4 * queries.count()


def test_groups_of_a_batch_find_what_pairs_find(spark, monkeypatch):
    """Copies, null and zero vectors, other lengths, null and infinite components, tiny and huge ones, null keys: as pair by pair, in groups of a few rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from skein.functions import vectors
    from skein.operators import search

    rng = np.random.default_rng(3)
    plain = [[float(x) for x in v] for v in np.round(rng.normal(size=(150, 4)), 1)]
    odd = [None, [0.0] * 4, [1.0, None, 1.0, 1.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1e-200] * 4, [1e200] * 4, []]
    given = [(i, v) for i, v in enumerate(plain + [plain[0]] * 40 + [[2 * x for x in plain[1]]] * 9 + odd * 6)] + [(None, plain[2])]
    rows = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 3 = 0 or vec_id between 199 and 210").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(search, "GROUP_ROWS", 16)
    monkeypatch.setattr(search, "GROUP_QUERIES", 8)
    pairs = rows.crossJoin(asked).select("query_id", "vec_id", vectors.cosine(F.col("embedding"), F.col("query")).alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("s"), "vec_id")
    wanted = pairs.withColumn("rank", F.row_number().over(order)).filter("rank <= 4").select("query_id", "rank", "vec_id", F.round("s", 4).alias("score"))
    found = search.top_k_batch(rows, asked, 4)
    show = lambda d: sorted(map(str, d.collect()))
    assert show(found) == show(wanted)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()

"""The inverted file of vectors: recall, pruned partitions, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import search
from skein.plans import adapters, ivf

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = adapters.load(spark, SF, "vectors")
    return rows, ivf.InvertedFile.build(rows, str(tmp_path_factory.mktemp("ivf")), 16)


def test_recall_of_the_nearest_lists(index):
    rows, found = index
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    probes = found.tune(asked)
    assert 1 <= probes <= 16
    exact = search.top_k_batch(rows, asked, 10)
    r = ivf.recall(exact, found.search_batch(asked, 10, probes)).first()
    assert r["queries"] == asked.count() and r["recall"] >= 0.9
    assert ivf.recall(exact, found.search_batch(asked, 10)).first()["recall"] == 1.0
    assert ivf.recall(exact, found.search_batch(asked, 10, 1)).first()["recall"] < r["recall"]


def test_every_row_has_a_list_and_a_search_reads_its_lists_only(index, capsys):
    rows, found = index
    assert found.rows.count() == rows.count() and {r["list"] for r in found.rows.select("list").distinct().collect()} <= set(range(16))
    query = rows.filter("vec_id = 0").first()["embedding"]
    near = found.search(query, 5, 2)
    near.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(list" in plan or "list#" in plan.split("PartitionFilters:")[1].split("]")[0]
    read = found.rows.filter(F.col("list").isin(found.lists(query, 2)))
    assert 0 < len(read.inputFiles()) and read.count() < rows.count()
    assert [r["vec_id"] for r in found.search(query, 5).collect()] == [r["vec_id"] for r in search.top_k(rows, query, 5).collect()]


def test_odd_vectors(spark, tmp_path):
    data = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.0, 0.0]), (4, "b", None), (5, "b", [1.0]), (6, "c", [1.0, 0.0]), (6, "c", [1.0, 0.0])]
    rows = spark.createDataFrame(data, "vec_id long, repo_name string, embedding array<float>")
    found = ivf.InvertedFile.build(rows, str(tmp_path / "a"), 5)
    assert {r["vec_id"] for r in found.rows.filter(F.col("list") == ivf.NOWHERE).collect()} == {3, 4, 5}
    assert [r["vec_id"] for r in found.search([1.0, 0.0], 3, 1).collect()] == [1, 6, 6]
    assert found.search([0.0, 0.0], 3, 1).count() == 0 and found.search(None, 3).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0])], "query_id long, query array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in found.search_batch(asked, 2).orderBy("rank").collect()] == [(1, 1), (1, 6)]
    none = ivf.InvertedFile.build(rows.limit(0), str(tmp_path / "b"))
    assert none.search([1.0, 0.0], 3, 2).count() == 0 and none.search_batch(asked, 2).count() == 0
    with pytest.raises(ValueError, match="list"):
        ivf.fit(rows, 0)


def test_groups_of_a_long_list_are_bounded(spark, tmp_path, monkeypatch):
    """Rows and queries of one list are dealt into several groups, and nothing is lost."""
    monkeypatch.setattr(ivf, "GROUP_ROWS", 50)
    monkeypatch.setattr(ivf, "GROUP_QUERIES", 3)
    x = np.random.default_rng(1).standard_normal((400, 8))
    rows = spark.createDataFrame([(i, "r", v.tolist()) for i, v in enumerate(x)], "vec_id long, repo_name string, embedding array<double>")
    found = ivf.InvertedFile.build(rows, str(tmp_path / "a"), 2)
    asked = rows.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert ivf.recall(search.top_k_batch(rows, asked, 10), found.search_batch(asked, 10)).first()["recall"] == 1.0

"""States in order, schedules, versions, deletion, listings and trees with pushed filters."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.functions import cron
from skein.operators import states, syntax
from skein.plans import versions
from skein.sources import listing, tree

T0 = datetime(2024, 1, 1)


def test_steps_cross_buckets(spark):
    """A day starts from what the day before it ended with; ties of time go by number; unknown states are illegal."""
    at = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    rows = [("a", at(0), 1, "pending"), ("a", at(0, 1), 2, "indexing"), ("a", at(3), 3, "error"), ("a", at(3), 4, "indexing"), ("a", at(9), 5, "indexing"), ("a", at(9, 1), 6, "indexed"), ("b", at(1), 7, "indexed"), ("b", at(2), 8, "odd"), (None, at(1), 9, "indexing")]
    got = {r["seq"]: (r["before"], r["legal"], r["attempt"]) for r in states.steps(spark.createDataFrame(rows, "repo_name string, at timestamp, seq long, status string")).collect()}
    assert got == {1: (None, True, 0), 2: ("pending", True, 1), 3: ("indexing", True, 1), 4: ("error", True, 2), 5: ("indexing", False, 3), 6: ("indexing", True, 3), 7: (None, False, 0), 8: ("indexed", False, 0), 9: (None, True, 1)}
    review = {r["repo_name"]: r for r in states.review(spark.createDataFrame(rows, "repo_name string, at timestamp, seq long, status string"), F.lit(at(10))).collect()}
    assert (review["a"]["illegal"], review["a"]["attempts"], review["a"]["failures"], review["a"]["indexing_seconds"]) == (1, 3, 1, 86400 * 3 - 3600 + 86400 * 6 + 3600)
    assert review[None]["stuck"] and not review["a"]["stuck"] and review["a"]["indexed_seconds"] == 23 * 3600


def fires_after(t, sets):
    minute, hour, day, month, weekday = sets
    t = t.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(60 * 24 * 400):
        if t.minute in minute and t.hour in hour and t.day in day and t.month in month and t.weekday() in weekday:
            return t
        t += timedelta(minutes=1)
    return None


@pytest.mark.parametrize(
    ("text", "sets"),
    [
        ("*/20 3-5,22 * * *", ({0, 20, 40}, {3, 4, 5, 22}, set(range(1, 32)), set(range(1, 13)), set(range(7)))),
        ("7 0 13 * fri", ({7}, {0}, {13}, set(range(1, 13)), {4})),
        ("0-10/5 12 1-7 feb-apr/2 *", ({0, 5, 10}, {12}, set(range(1, 8)), {2, 4}, set(range(7)))),
        ("5/10 * * * *", None), ("60 * * * *", None), ("* * * *", None), ("", None), ("a b c d e", None), ("0 9-5 * * *", None), ("*/0 * * * *", None),
    ],
)
def test_schedules(spark, text, sets):
    """Against a walk over minutes; broken expressions fire every six hours."""
    sets = sets or ({0}, {0, 6, 12, 18}, set(range(1, 32)), set(range(1, 13)), set(range(7)))
    times = [T0 + timedelta(hours=7 * k, minutes=11 * k, seconds=k) for k in range(40)] + [datetime(2024, 2, 28, 23, 59, 59), datetime(2024, 3, 31, 12, 10)]
    rows = spark.createDataFrame([(t,) for t in times], "at timestamp_ntz")
    got = {r["at"]: r["fires_at"] for r in cron.next_firings(rows, spark.createDataFrame([("s", text)], "schedule string, expression string")).collect()}
    assert got == {t: fires_after(t, sets) for t in times}


def test_readers_never_see_half(spark, tmp_path):
    held = versions.VersionedStore(spark, str(tmp_path / "store"))
    rows = lambda *pairs: spark.createDataFrame(pairs, "repo string, x long")
    seen = lambda: sorted((r["repo"], r["x"]) for r in held.read("t").collect())
    held.replace(rows(("a", 1), ("a", 2), ("b", 3)), "t", "repo")
    version, _ = held.write(rows(("a", 9), ("b", 9)), "t", "repo")  # the writer fails here
    assert seen() == [("a", 1), ("a", 2), ("b", 3)] and held.stale("t").count() == 2
    held.replace(rows(("a", 5)), "t", "repo")
    assert seen() == [("a", 5), ("b", 3)]
    held.commit(held.written("t", version))  # the commit is done again after all
    held.commit(held.written("t", version))
    assert seen() == [("a", 9), ("b", 9)]
    held.replace(rows().limit(0), "t", "repo", spark.createDataFrame([("b",)], "part string"))
    assert seen() == [("a", 9)] and held.current("t").count() == 1
    assert held.vacuum("t") == 4 and held.stale("t").count() == 0 and seen() == [("a", 9)]
    held.replace(spark.createDataFrame([("r", 1)], "name string, n long"), "whole")
    held.replace(spark.createDataFrame([], "name string, n long"), "whole")
    assert held.read("whole").count() == 0


def test_deletion_is_one_commit(spark, tmp_path):
    held = versions.VersionedStore(spark, str(tmp_path / "store"))
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    held.replace(names.select(F.col("name").alias("repo_name"), F.lit(1).alias("x")), "chunks", "repo_name")
    for name in ("repos", "config"):
        held.replace(names, name)
    held.replace(spark.createDataFrame([("a",), (None,), ("c",)], "repo_name string"), "queue")
    before = held.commits().agg(F.max("number")).first()[0]
    versions.delete_repos(held, spark.createDataFrame([("a",), ("zz",), (None,), ("a",)], "name string"))
    assert held.commits().agg(F.max("number")).first()[0] == before + 1 and len(held.commits().filter(F.col("number") == before + 1).inputFiles()) >= 1
    for name, left in (("chunks", ["b", "c"]), ("repos", ["b", "c"]), ("config", ["b", "c"])):
        assert sorted(r[0] for r in held.read(name).collect()) == left
    assert sorted((r[0] for r in held.read("queue").collect()), key=str) == [None, "c"] or [r[0] for r in held.read("queue").collect()] == ["c", None]
    versions.delete_repos(held, names)
    assert all(held.read(name).count() == 0 for name in ("chunks", "repos", "config")) and held.read("queue").count() == 1


class Counting(listing.Folder):
    """Notes each page that is fetched, in a folder."""

    def fetch(self, page):
        with open(f"{self.root}/_fetched-{page.host}-{page.name}", "w"):
            pass
        return super().fetch(page)


def test_filters_skip_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 'github', 'gitlab') AS host", "id", "concat('o/', id) AS full_name", "CAST(NULL AS string) AS visibility", "id * 10 AS last_activity_at")
    listing.save_pages(rows, path)
    found = lambda **o: listing.read(spark, path, transport="tests.test_repos:Counting", **o)
    assert found(pushdown="true").filter("host = 'github' and last_activity_at >= 9000 and last_activity_at < 9400").count() == sum(k % 3 == 0 and 9000 <= 10 * k < 9400 for k in range(1000))
    assert sorted(x for x in os.listdir(path) if x.startswith("_fetched")) == ["_fetched-github-9000-9499"]
    assert found(pushdown="true").filter("host in ('github', 'nobody') and id = 3").count() == 1
    assert len([x for x in os.listdir(path) if x.startswith("_fetched")]) == 20
    every = found()  # without it, one DataFrame may be used as often as one likes
    assert every.filter("host = 'github'").count() == 334 and every.count() == 1000
    assert every.filter("host = 'github'").union(every.filter("host = 'gitlab'")).count() == 1000


def test_filters_open_no_other_files(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    for name in ("top.md", "a/x.py", "a/b/y.py", "c/z.py", "c/big.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name * (1000 if "big" in name else 1))
    tree.register(spark)
    rows = spark.read.format("repo_tree").load(str(root))
    fresh = lambda: spark.read.format("repo_tree").option("pushdown", "true").load(str(root))
    assert rows.count() == 5 and rows.rdd.getNumPartitions() == 3
    assert [r["file_path"] for r in fresh().filter("file_path = 'a/b/y.py'").collect()] == ["a/b/y.py"]
    assert fresh().filter("file_path = 'a/b/y.py'").rdd.getNumPartitions() == 2
    assert {r["file_path"] for r in fresh().filter("size < 100 and file_path like 'c/%'").collect()} == {"c/z.py"}
    wanted = tree.Wanted()
    wanted.take(tree.StringStartsWith(("file_path",), "a/b"))
    opened = [p for p, _ in tree.walk(str(root), [], 500, wanted=wanted)]
    assert opened == ["a/b/y.py"]
    wanted.take(tree.LessThan(("size",), 3))
    assert not list(tree.walk(str(root), [], 500, wanted=wanted))


def test_definitions_that_lie_too_deep_and_annotated_classes():
    body = "    def inner(a):\n        return 'long enough to be a chunk'\n"
    for head in ("try:\n" + body + "except* ValueError:\n    pass\n", "async def f():\n    async with x:\n        def g():\n            return 1\n    return 'long enough'\n"):
        assert all(name != "inner" and name != "g" for _, name, _, _ in syntax.syntax_chunks(head, "python"))
    java = "@Deprecated @SuppressWarnings(\"x\") public final class C {\n  int value = 12345;\n}\n\npublic interface D {\n  int otherValue();\n}\n"
    assert [(k, n) for k, n, _, _ in syntax.syntax_chunks(java, "java")] == [("class_declaration", "C"), ("interface_declaration", "D")]


def test_queries_on_empty_tables(spark, tmp_path):
    """No query over vectors, texts, memories or jobs needs a row to be there."""
    from skein import queries

    for name in ("documents", "embeddings", "events", "conversations", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("vector_topk", "vector_topk_filtered", "vector_topk_empty_filter", "unified_groups", "related_edges_for_results", "text_search_hash", "memory_search", "unified_search", "job_stale", "vector_index_batch", "repo_state_review", "refresh_next"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0, name


def test_texts_without_words_come_last(spark):
    from skein.operators import embed, memory

    rows = spark.createDataFrame([("1", "u", "a b"), ("2", "u", " "), ("3", "u", None), ("4", "u", "a")], "memory_id string, user_id string, memory string")
    vectors = embed.hashed_columns(rows, "memory_id", "memory")
    wanted = vectors.filter("memory_id = '4'").first()["embedding"]
    found = memory.search(rows.select("memory_id", "user_id").join(vectors, "memory_id"), wanted, "u").collect()
    assert [r["memory_id"] for r in found] == ["4", "1", "2", "3"] and [r["score"] for r in found][2:] == [None, None]


def test_every_document_is_a_file(spark, tmp_path):
    """Rows of one id and source, and sources that are no plain names, come back as they are; 3,000 files take no commit that goes through them."""
    import duckdb

    from skein import queries

    rows = [(k, f"text {k}\r\nline", "src3", "de", 10) for k in range(3000)] + [(7, "again", "src3", "de", 5), (7, "ä", None, "de", 1), (8, "x", "a/b c+%", "de", 1), (9, None, "src1", "de", 0), (10, "", "src1", "de", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    theirs = duckdb.sql(queries.ORACLE["tree_documents"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    ours = [tuple(r) for r in queries.QUERIES["tree_documents"](spark, str(tmp_path)).collect()]
    assert len(ours) == 3003 and sorted(ours, key=str) == sorted(theirs, key=str)


def test_saved_files_replace_themselves(spark, tmp_path):
    root, rows = str(tmp_path / "tree"), spark.range(20, numPartitions=3).selectExpr("id % 4 AS part", "id", "if(id = 5, NULL, concat('t', id)) AS content")
    os.makedirs(root)
    assert tree.save(rows, root, ("part", "id")) == 19 and tree.save(rows, root, ("part", "id")) == 19
    tree.register(spark)
    back = spark.read.format("repo_tree").load(root)
    got = back.select(tree.saved_value(F.col("file_path"), "id").cast("long").alias("id"), "content", "size").collect()
    assert {(r["id"], r["content"], r["size"]) for r in got} == {(k, f"t{k}\n", len(f"t{k}\n")) for k in range(20) if k != 5} and len(got) == 19

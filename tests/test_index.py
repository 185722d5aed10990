"""Trees, storage and the request queue, end to end in a temporary folder."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skein.model import IndexSettings
from skein.plans import index, store
from skein.sources import catalog, tree
from skein.streaming import queue


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, content in {
        ".env": b"x", ".github/ci.yml": b"on: push", "src/__init__.py": b"", "_u.md": b"# u", "foo.lock/a.md": b"no", "node_modules/z.js": b"no",
        "crlf.txt": b"a\r\nb\rc", "bad.txt": bytes.fromhex("61ffc3289fe282"), "empty.md": b"", "big.txt": b"x" * 512001, "fit.txt": b"x" * 512000,
        "src/m.py": b"def top(a):\n    return 'long enough to be a chunk'\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_tree(spark, repo):
    rows = {r["file_path"]: r["content"] for r in index.scan(spark, repo, "r").collect()}
    assert set(rows) == {".github/ci.yml", "src/__init__.py", "_u.md", "crlf.txt", "bad.txt", "empty.md", "fit.txt", "src/m.py"}
    assert rows["crlf.txt"] == "a\nb\nc" and rows["bad.txt"] == "a��(��"
    assert tree.read_file(repo, "/_u.md") == "# u"
    for path in ("../x", "/../../etc/passwd"):
        with pytest.raises(ValueError, match="out of"):
            tree.read_file(repo, path)


def test_index_and_replace(spark, repo, tmp_path):
    out = str(tmp_path / "chunks")
    assert [r["status"] for r in index.index_repo(spark, repo, "one", out).collect()] == ["indexing", "indexed"]
    index.index_repo(spark, repo, "two", out)
    first = spark.read.parquet(out).groupBy("repo_name").count().collect()
    assert len({r["count"] for r in first}) == 1 and len(first) == 2
    index.index_repo(spark, repo, "one", out)  # again: nothing doubles
    assert {tuple(r) for r in spark.read.parquet(out).groupBy("repo_name").count().collect()} == {tuple(r) for r in first}

    def broken():
        raise RuntimeError("no client")

    states = index.index_repo(spark, repo, "one", out, broken).collect()
    assert states[-1]["status"] == "error" and spark.read.parquet(out).filter("repo_name = 'one'").count() > 0
    nothing = IndexSettings(excludes=("*",))
    index.index_repo(spark, repo, "one", out, settings=nothing)
    assert spark.read.parquet(out).filter("repo_name = 'one'").count() > 0
    index.index_repo(spark, repo, "one", out, settings=nothing, on_empty="clear")
    assert [r[0] for r in spark.read.parquet(out).select("repo_name").distinct().collect()] == ["two"]
    with pytest.raises(ValueError, match="keep or clear"):
        store.replace(spark.range(0), out, "drop")


def test_queue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": 1, "repo_name": "b", "requested_at": "2024-01-01T00:00:02Z"}, {"id": 2, "repo_name": "gone", "requested_at": "2024-01-01T00:00:00Z"}, {"id": 3, "repo_name": "a", "requested_at": "2024-01-01T00:00:01Z"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    repos, done = spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), []

    def once():
        q = queue.consume(spark, str(tmp_path / "in"), str(tmp_path / "cp"), repos, done.append)
        q.awaitTermination(60)

    once()
    assert done == ["a", "b"]
    once()  # acknowledged: nothing runs again
    assert done == ["a", "b"]
    (tmp_path / "in" / "2.json").write_text(json.dumps({"id": 4, "repo_name": None, "requested_at": "2024-01-02T00:00:00Z"}))
    once()
    assert done == ["a", "b", "a", "b", "c"]


def test_remote_catalogues(spark, tmp_path):
    (tmp_path / "gh.json").write_text(json.dumps({"id": 1, "name": "n", "full_name": "o/n", "updated_at": "2024"}))
    (tmp_path / "gl.json").write_text(json.dumps({"id": 2, "name": "n", "path_with_namespace": "", "name_with_namespace": "g / n"}))
    gh = catalog.github(spark, str(tmp_path / "gh.json")).first()
    gl = catalog.gitlab(spark, str(tmp_path / "gl.json")).first()
    assert (gh["stars"], gh["fork"], gh["private"], gh["default_branch"]) == (0, False, False, "main")
    assert (gl["full_name"], gl["private"], gl["fork"]) == ("g / n", True, False)
    assert gl.asDict().keys() == gh.asDict().keys()
    assert spark.range(1).select(F.lit(1)).count() == 1

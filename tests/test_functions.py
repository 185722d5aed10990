"""Golden values of the path, glob, chunk, vector and text functions."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import globs, paths, text, vectors
from skein.model import EXCLUDES, IndexSettings
from skein.operators import catalog, chunk, embed, jobs, memory, search, syntax
from skein.sources import tree

PATHS = [  # path, excluded, suffix, indexable
    ("src/main.py", False, ".py", True), ("src/__init__.py", False, ".py", True), (".github/ci.yml", False, ".yml", True), (".gitignore", False, "", False),
    (".env", False, "", False), ("prod.env", False, ".env", True), ("Dockerfile", False, "", False), ("app.dockerfile", False, ".dockerfile", True), ("A.PY", False, ".py", True),
    ("dist", True, "", False), ("src/dist/x.js", True, ".js", False), ("build/a.ts", True, ".ts", False), ("Build/a.ts", False, ".ts", True), ("redist/a.ts", False, ".ts", True),
    ("src/coverage", True, "", False), ("poetry.lock", True, ".lock", False), ("a/b.lock", True, ".lock", False), ("package-lock.json", True, ".json", False), ("x/package-lock.json", True, ".json", False),
    ("app.min.js", True, ".js", False), ("min.js", False, ".js", True), ("lib/.pyc", True, "", False), ("m.pyc", True, ".pyc", False), ("x.svg", False, ".svg", False), ("notes.tar.gz", False, ".gz", False),
    ("foo.", False, "", False), ("a.b/Makefile", False, "", False), ("yarn.lock.md", False, ".md", True), (".git/config.cfg", True, ".cfg", False),
]


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p, *_ in PATHS], "path string")
    p = F.col("path")
    got = rows.select("path", globs.excluded(p, EXCLUDES), paths.suffix(p), paths.indexable(p) & ~globs.excluded(p, EXCLUDES)).collect()
    assert [tuple(r) for r in got] == PATHS
    test = tree.matcher(EXCLUDES)
    assert [test(x) for x, *_ in PATHS] == [e for _, e, *_ in PATHS]
    folder = spark.createDataFrame([("foo.lock/a.md",)], "path string")
    assert folder.select(globs.excluded(p, EXCLUDES), globs.pruned(p, EXCLUDES)).first()[:] == (False, True)


@pytest.mark.parametrize(
    ("content", "spans"),
    [
        ("", []), ("a" * 1400, [(0, 1400)]), ("a" * 1401, [(0, 1401), (1400, 1401)]), ("a" * 1600, [(0, 1600), (1400, 1600)]),
        ("a" * 3000, [(0, 1600), (1400, 3000), (2800, 3000)]), ("a" * 500 + "\n" + "b" * 2000, [(0, 500), (1400, 2501)]),
        ("\n" + "a" * 2000, [(0, 1600), (1400, 2001)]), ("a" * 1590 + "\n" + "b" * 100, [(0, 1590), (1400, 1691)]),
    ],
)
def test_windows(spark, content, spans):
    rows = chunk.sliding_chunks(spark.createDataFrame([(content,)], "content string")).orderBy("chunk_index").collect()
    assert [(r["start"], r["start"] + len(r["chunk"])) for r in rows] == spans
    assert all(content[r["start"] :].startswith(r["chunk"]) for r in rows)


def test_windows_guard_and_gapless(spark):
    frame = spark.createDataFrame([("a" * 500 + "\n" + "b" * 2000,), (None,)], "content string")
    with pytest.raises(ValueError, match="overlap"):
        chunk.sliding_chunks(frame, 50, 50)
    with pytest.raises(ValueError, match="overlap"):
        IndexSettings(10, 10)
    rows = chunk.sliding_chunks(frame, gapless=True).collect()
    assert sorted(len(r["chunk"]) for r in rows) == [1101, 1600]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["**/x/**", "*.lock", "a?c", "[ab].py", "q"]), max_size=4), st.text("abcx/.q", max_size=12))
def test_more_globs_exclude_more(patterns, path):
    assert not tree.matcher(patterns)(path) or tree.matcher([*patterns, "**/zz/**"])(path)


def test_vectors(spark):
    v = [1.0, 0.0]
    rows = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [2.0, 0.0]), (2, "B", [0.0, 0.0]), (3, "B", None), (4, "b", [-1.0, 0.0])], "vec_id long, repo_name string, embedding array<float>")
    got = search.top_k(rows, v, 5).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 1.0), (1, 1.0), (4, -1.0), (2, None), (3, None)]
    means = {r["repo_name"]: (r["n"], r["mean"]) for r in vectors.mean_vectors(rows, "repo_name", "embedding").collect()}
    assert means == {"a": (2, [1.5, 0.0]), "B": (2, [0.0, 0.0]), "b": (1, [-1.0, 0.0])}
    pairs = search.relationships(rows).collect()
    assert [(r["repo_a"], r["repo_b"]) for r in pairs] == [("a", "b"), ("B", "a"), ("B", "b")]
    assert search.top_k(rows, v, 5, ["B"]).count() == 2 and search.top_k(rows, v, 9, []).count() == 5
    assert rows.select(vectors.to_text(F.col("embedding")).alias("t")).first()["t"] == "[1.0000000000,0.0000000000]"


def test_labels(spark):
    row = spark.createDataFrame([(" a \n b c ", "a/b/c", "src/a//b")], "t string, s string, p string")
    got = row.select(
        text.snippet(F.col("t"), 4), text.slug(F.col("s")), text.first_slash_slug(F.col("s")), text.human_bytes(F.lit(1024)), text.human_bytes(F.lit(0)), text.human_bytes(F.lit(1280)), text.duration_label(F.lit(999)), text.duration_label(F.lit(60000)),
        F.transform(paths.breadcrumbs(F.col("p")), lambda c: c["path"]), text.inject_token(F.lit("https://h:8/x"), F.lit("t$k")), text.lines(F.lit(" a \n\n b")), text.tool_group(F.lit("repo_list")), catalog.local_path(F.lit("local"), F.lit(""), F.lit("r")),
    ).first()
    assert got[:] == ("a b ...", "a-b-c", "a-b/c", "1.0 KB", "—", "1.3 KB", "999ms", "1.0m", ["src", "src/a", "src/a/b"], "https://oauth2:t$k@h:8/x", ["a", "b"], "repo", "/repos/r")


def test_metadata_and_memories(spark):
    rows = spark.createDataFrame([(None,), ('{"a":1}',), ("[1]",), ("5",), ("{",)], "m string")
    assert [r[0] for r in rows.select(memory.metadata_kind(F.col("m"))).collect()] == ["empty", "object", "error", "error", "error"]
    kept = spark.createDataFrame([("1", "u", "x", [1.0])], "memory_id string, user_id string, memory string, embedding array<double>")
    more = memory.add(kept, spark.createDataFrame([("2", None, "y")], "memory_id string, user_id string, memory string"))
    assert memory.listing(more).first()["memory_id"] == "2" and memory.remove(more, "1").count() == 1 and memory.search(more, [1.0], "u").first()["score"] == 1.0


class Client:
    def __init__(self, fails: int, message: str = "HTTP 429") -> None:
        self.calls, self.fails, self.message = [], fails, message

    def __call__(self, texts: list[str]) -> list[list[float]]:
        self.calls.append(len(texts))
        if len(self.calls) <= self.fails:
            raise RuntimeError(self.message)
        return [[float(t)] for t in texts]


@pytest.mark.parametrize(("n", "fails", "calls"), [(4, 0, [4]), (4, 1, [4, 2, 2]), (3, 1, [3, 1, 2]), (45, 0, [20, 20, 5])])
def test_embedding_order(n, fails, calls):
    client, waits = Client(fails), []
    assert embed.embed_all([str(i) for i in range(n)], client, waits.append) == [[float(i)] for i in range(n)]
    assert client.calls == calls and not waits


def test_embedding_failures():
    client, waits = Client(9), []
    with pytest.raises(RuntimeError):
        embed.embed_all(["1"], client, waits.append)
    assert client.calls == [1] * 5 and waits == [1, 2, 4, 8]
    client = Client(9, "bad key")
    with pytest.raises(RuntimeError):
        embed.embed_all(["1", "2"], client, waits.append)
    assert client.calls == [2]


SOURCE = '''import os
# é
def top(a):
    return "long enough to be kept here"

@deco
class Known:
    def method(self):
        return "inside a class, not captured"

if True:
    def hidden():
        return "nested under a condition, not captured"

def f(): pass
'''


def test_syntax():
    got = [(k, n, s) for k, n, s, _ in syntax.syntax_chunks(SOURCE, "python")]
    assert got == [("function_definition", "top", 2), ("decorated_definition", None, 5)]
    assert syntax.syntax_chunks("def (", "python") == [] and syntax.syntax_chunks("x", "cobol") == []
    go = "package x\n\nfunc (s *S) Do(a int) error {\n\treturn nil // comment here\n}\n"
    assert [(k, n) for k, n, *_ in syntax.syntax_chunks(go, "go")] == [("method_declaration", "Do")]
    js = "export default async (a) => {\n  return '}' + a; // } not the end\n}\nclass Longer { method() { return 1 } }\nenum Color { Red, Green, Blue, Yellow }\n"
    assert [(k, n, s) for k, n, s, _ in syntax.syntax_chunks(js, "javascript")] == [("arrow_function", None, 0), ("class_declaration", "Longer", 3)]


def test_job_search(spark):
    rows = spark.createDataFrame([("job-1", "http", "done", None), ("job-2", "index", "error", "HTTP 503")], "job_id string, tool string, status string, error_message string")
    assert rows.filter(jobs.matches(" 503 ")).count() == 1 and rows.filter(jobs.matches("  ")).count() == 2


def test_states_keep_what_a_transition_does_not_set(spark):
    repos = spark.createDataFrame([("a", "pending", 3), ("b", "pending", 0), ("c", "indexed", 5)], "name string, status string, total_chunks long")
    log = [("a", 1, 1, "indexed", 9, None), ("a", 2, 2, "error", None, "no"), ("b", 1, 1, "error", None, "no"), ("b", 1, 2, "indexing", None, None)]
    got = catalog.apply_states(repos, spark.createDataFrame(log, "repo_name string, at int, seq int, status string, total_chunks long, error_message string"))
    assert {tuple(r) for r in got.collect()} == {("a", "error", 9, 1, "no"), ("b", "indexing", 0, None, None), ("c", "indexed", 5, None, None)}


def test_blank_words_search_nothing(spark):
    rows = spark.createDataFrame([(1, "k", 0.5)], "place int, key string, score double")
    assert search.unified("x", rows, rows, rows, rows).count() == 4 and search.unified(" \t", rows, rows, rows, rows).count() == 0


def test_requests_for_unknown_repositories(spark):
    queue = spark.createDataFrame([(1, "a", None)], "id long, repo_name string, processed_at string")
    asked, repos = spark.createDataFrame([(2, "a"), (3, "no"), (4, None)], "id long, repo_name string"), spark.createDataFrame([("a",)], "name string")
    assert sorted(r["id"] for r in jobs.enqueue(queue, asked, repos).collect()) == [1, 2, 4]
    assert sorted(r["id"] for r in jobs.enqueue(queue, asked).collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in jobs.enqueue(queue, asked, repos.limit(0)).collect()) == [1, 4]

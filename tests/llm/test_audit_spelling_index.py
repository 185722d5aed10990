"""The filter audit, spelling variants and the multi-index, against plain versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.llm import filter_audit, hamming_index, queries, spelling

SF = "/root/testdata/sf0.001"


# --- filter audit ----------------------------------------------------------------------------------------------------


def plain_audit(rows, filters, marks):
    """{(part, order, step): figures} by applying every order to lists."""
    out = {}
    for part in {r["part"] for r in rows}:
        own = [r for r in rows if r["part"] == part]
        shapley = Counter()
        for order in permutations(filters):
            alive = own
            for step, f in enumerate(order, 1):
                lost, before = [r for r in alive if r[f]], alive
                alive = [r for r in alive if not r[f]]
                shapley[f] += len(lost)
                fails = sum(r[f] for r in own)
                out[part, "".join(order), step] = [f, len(alive), len(lost), fails - len(lost), sum(r[f] and sum(r[g] for g in filters) == 1 for r in own), *[sum(r[m] for r in lost) for m in marks]]
                assert len(before) == len(alive) + len(lost)
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[out[key][0]])
    return {k: v[1:] for k, v in out.items()}


def audited(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in frame.collect()}


def test_audit_of_odd_documents(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (5, 1, None), (7, None, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    spread = odd.withColumn("source", F.when(F.col("source") == "a", None).otherwise(F.col("source")))
    docs = spread.select("doc_id", "text", "source").collect()
    good, toxic = {3, 5, 11}, {3, 7, 11}
    rows = []
    for d in docs:
        text = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        rows.append({
            "part": d["source"] or "", "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": d["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < d["doc_id"] and (o["text"] or "") == text for o in docs), "good": d["doc_id"] in good, "toxic": d["doc_id"] in toxic,
        })
    got = audited(filter_audit.audit_documents(spread, labels))
    assert got == plain_audit(rows, "ABCDE", ["good", "toxic"])
    assert {k[0] for k in got} == {"", "b", "c"}


def test_audit_of_nothing_and_of_bad_filters(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(none, labels).count() == 0
    for names in ([], ["A", "A"], list("ABCDEFGH")):
        with pytest.raises(ValueError, match="filters"):
            filter_audit.audit(spark.range(1), names)


def test_audit_is_memoised(spark):
    rows = spark.createDataFrame([("x", True, None, False), ("x", False, True, True), ("y", True, True, True)], "part string, f boolean, g boolean, h boolean")
    states = filter_audit.walk(rows, ["f", "g", "h"], "part", [])
    met = [(r["part"], r["state"]) for r in states.collect()]
    assert len(met) == len(set(met)) and {s for _, s in met} <= {"", "f", "g", "h", "fg", "fh", "gh"}
    out = filter_audit.audit(rows, ["f", "g", "h"])
    assert out.count() == 2 * 6 * 3 and out.filter("kept < 0 or redundant < 0").isEmpty()


def test_audit_same_as_sql(spark):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    theirs = con.sql(queries.ORACLE["op11_filter_audit"]).df()
    ours = queries.QUERIES["op11_filter_audit"](spark, SF).toPandas()[list(theirs.columns)]
    assert sorted(map(tuple, ours.to_numpy().tolist())) == sorted(map(tuple, theirs.to_numpy().tolist()))


# --- spelling variants -----------------------------------------------------------------------------------------------


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:k] + long_[k + 1 :] == short for k in range(len(long_)))


def plain_words(docs, shortest=7, least=2):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= shortest:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= least}


def plain_variants(words):
    near = {w: [] for w in words}
    by_hole = {}
    for w in words:  # words at distance one share a pattern with one place open
        for k in range(len(w) + 1):
            for key in {("r", w[:k] + "\0" + w[k + 1 :]), ("i", w[:k] + "\0" + w[k:])}:
                by_hole.setdefault(key[1], set()).add(w)
    for group in by_hole.values():
        for a in group:
            near[a] += [b for b in group if b != a and b not in near[a] and differ_by_one(a, b)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def variants(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_of_documents(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    want = plain_variants(plain_words(docs))
    assert variants(queries.QUERIES["op12_spelling_variants"](spark, SF)) == want
    assert sum(v[0] is not None for v in want.values()) > 5


def test_variants_in_many_small_shards(spark, monkeypatch):
    """Shards and blocks of a few words give what one gives; forms lead on over several steps; any code point is a letter."""
    for name, value in (("SHARD_WORDS", 3), ("SHARD_POINTS", 40), ("BLOCK_POINTS", 90)):
        monkeypatch.setattr(spelling, name, value)
    words = {"aaaaaaa": 3, "aaaaaaaa": 40, "aaaaaaab": 40, "aaaaaaabc": 900, "aaaaaaabcd": 90_000, "b": 1, "ab": 12, "": 5, "日本語": 4, "日本": 50, "日本語😀": 400, "z" * 3000: 2, "z" * 2999: 30}
    got = variants(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words)
    assert got["aaaaaaa"][:2] == ("aaaaaaaa", "aaaaaaaa") and got["aaaaaaab"][:2] == ("aaaaaaabc", "aaaaaaabcd")


def test_automaton_on_random_words():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(250)})
    edges, ends = spelling.build_trie(words)
    shard = spelling.Shard({"words": words, "counts": [1] * len(words), "edges": edges.tobytes(), "ends": ends.tobytes()})
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if differ_by_one(a, b)}
    for held in (1, 40, 1 << 18):
        found = list(zip(*map(np.ndarray.tolist, spelling.neighbours(words, shard, held)), strict=True))
        assert len(found) == len(set(found)) and set(found) == want


def test_variants_of_odd_documents(odd, none, spark):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert variants(spelling.group_variants(odd)) == plain_variants(plain_words(docs))
    assert spelling.group_variants(none).count() == 0


# --- multi-index hashing ---------------------------------------------------------------------------------------------


def plain_nearest(ids, x, queries_, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries_:
        score = unit @ unit[q]
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-score[i], ids[i]))
        out[ids[q]] = [(ids[i], score[i]) for i in order[:k]]
    return out


def test_recall_and_scores(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].tolist(), np.stack(rows["embedding"]).astype(float)
    want = plain_nearest(ids, x, [i for i, v in enumerate(ids) if v % 50 == 0])
    got = queries.QUERIES["op13_nearest_vectors"](spark, folder).toPandas()
    assert set(got["query_id"]) == set(want) and (got.groupby("query_id").size() == 5).all()
    hits = sum(len(set(g["vec_id"]) & {i for i, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert hits >= 0.95 * 5 * len(want)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    place = {v: i for i, v in enumerate(ids)}
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(g["vec_id"])
        np.testing.assert_allclose(g["score"], [unit[place[q]] @ unit[place[v]] for v in g["vec_id"]], atol=1e-12)
        assert (np.diff(g["score"]) <= 0).all()


def test_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    x = hamming_index.unit(rng.standard_normal((500, 24)))
    turns = hamming_index.learn_rotations(x)
    frame = next(hamming_index._build_shards(turns, iter([pd.DataFrame({"vector": list(x), "ids": [[i] for i in range(500)]})])))
    shard = hamming_index.Shard(frame.iloc[0].to_dict())
    apart = np.bitwise_count(shard.codes[:20, None, :] ^ shard.codes[None, :, :]).sum(axis=2)
    for radius in (0, 3, 8, 17, 29, 64):
        query, row = shard.within(shard.codes[:20], radius)
        found = list(zip(query.tolist(), row.tolist(), strict=True))
        assert len(found) == len(set(found)) and set(found) == set(zip(*map(np.ndarray.tolist, np.nonzero(apart <= radius)), strict=True))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, -0.0]), (5, [0.0, 1.0, 0.0]), (6, [1e300, 1e300, 0.0]), (7, [1e-300, 0.0, 2e-300]), (8, [-1.0, 0.0, 0.0]),
        (9, None), (10, []), (11, [0.0, 0.0, 0.0]), (12, [nan, 1.0, 1.0]), (13, [inf, 1.0, 1.0]), (14, [None, 1.0, 1.0]), (15, [1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (150, [1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "h1", "near", "block", "ids")})
    got = hamming_index.nearest(frame, F.col("id") % 50 == 0, 5).collect()
    found = {q: [(r["vec_id"], round(r["score"], 9)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] for q in {r["query_id"] for r in got}}
    half, low = round(0.5**0.5, 9), round(0.2**0.5, 9)
    assert found == {0: [(3, 1.0), (4, 1.0), (50, 1.0), (6, half), (7, low)], 50: [(0, 1.0), (3, 1.0), (4, 1.0), (6, half), (7, low)]}
    assert hamming_index.nearest(frame.filter("vec_id is null"), F.col("id") % 50 == 0).count() == 0
    assert hamming_index.nearest(frame.filter("vec_id in (0, 3)"), F.col("id") % 50 == 0).count() == 1
    assert hamming_index.nearest(frame.filter("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_many_copies_of_one_vector(spark):
    """A third of all rows with one vector: a class keeps a few ids, and every copy that is asked gets its answer."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 16))
    x[::3] = x[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = hamming_index.MultiIndex(frame)
    assert index.classes.filter("size(ids) > 6").isEmpty() and index.classes.count() == 1001
    got = index.search(F.col("id") % 50 == 0).toPandas()
    copies = got[got["query_id"] % 3 == 0]
    assert len(got) == 150 and len(copies) == 50
    for q, g in copies.groupby("query_id"):
        assert g.sort_values("rank")["id"].tolist() == [i for i in range(0, 18, 3) if i != q][:5]

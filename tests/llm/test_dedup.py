"""Near duplicates, repeated passages and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import bytetext, fingerprint, near_dedup, suffix_dedup
from skein.llm.components import connected_components
from skein.llm.rlindex import RunLengthIndex, suffix_order


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    inverse, common, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            inverse[g].append(i)
    for ids in inverse.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited_group(n, seed):
    """Copies of one text with growing shares of replaced words: links, chains and misses around the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(10**6)}" for _ in range(80)]
    for i in range(n):
        text = list(base)
        for k in rng.choice(80, i % 12, replace=False):
            text[k] = f"x{rng.integers(10**6)}"
        yield " ".join(text)


def test_near_duplicates(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(edited_group(60, 1))] + [(2000 + i, t) for i, t in enumerate(edited_group(40, 2))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd(odd, none):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd).collect())
    assert got[:4] == [(0, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [g[2:] for g in got if g[0] in (5, 6, 7)] == [(5, True), (5, False), (5, False), (5, False)]
    assert [g[2:] for g in got if g[0] == 11] == [(4, False)]
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 9


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (90, 95, 100)} == {90}


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        grams, gone = [b[k : k + 50] for k in range(len(b) - 49)], np.zeros(len(b), bool)
        for k, g in enumerate(grams):
            if g in seen:
                gone[k : k + 50] = True
        seen.update(grams)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))[: len(gone)]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats(spark, small, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1 << 16)  # several blocks and buckets
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    rows += [(500 + i, "a" * (40 + i)) for i in range(30)] + [(600, "ab" * 60), (601, "ba" * 60), (602, "é" * 60), (603, rows[3][1][10:] + rows[7][1][:70])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == brute_repeats(rows)


def test_repeats_odd(odd, none):
    rows = suffix_dedup.remove_repeats(odd, keep_columns=True, figures="found")
    assert set(rows.columns) == {*odd.columns, "found"}
    got = {r["doc_id"]: r for r in rows.collect()}
    assert got[1]["found"]["n_bytes"] == 0 and got[4]["found"]["n_removed"] == 0 and got[11]["text"] == "" and got[11]["n_removed"] == "x"
    assert rows.count() == odd.count() and suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 5, 26])
def test_index(letters):
    rng = np.random.default_rng(letters)
    base, phrases = rng.integers(97, 97 + letters, 400).astype(np.uint8), {}
    for _ in range(60):
        a = rng.integers(0, 320)
        phrases.setdefault(base[a : a + rng.integers(50, 81)].tobytes(), int(rng.integers(1000)))
    size = np.array([len(p) for p in phrases])
    least: dict[bytes, int] = {}
    for p, d in phrases.items():
        for k in range(len(p) - 49):
            least[p[k : k + 50]] = min(d, least.get(p[k : k + 50], d))
    index = RunLengthIndex(np.frombuffer(b"".join(phrases), np.uint8), size)
    got = index.least(np.array(list(phrases.values())), 50)
    assert got.tolist() == [least[p[k : k + 50]] for p in phrases for k in range(len(p) - 49)]
    assert index.runs < index.symbols / 2 or letters < 5
    whole = b"\0" + b"\0".join(phrases) + b"\0"
    order = sorted(range(len(whole)), key=lambda i: whole[i:])
    before = dict(zip(order[1:], order[:-1], strict=True))
    other, length = index.stream()
    assert {i: o for i, o in enumerate(other.tolist()) if i != order[0]} == before
    assert all(length[i] == len(os.path.commonprefix([whole[i:], whole[o:]])) for i, o in before.items())
    for depth in (20, 50, 60):
        by_bytes: dict[bytes, int] = {}
        for p, d in phrases.items():
            for k in range(len(p) - depth + 1):
                by_bytes[p[k : k + depth]] = min(d, by_bytes.get(p[k : k + depth], d))
        assert index.least(np.array(list(phrases.values())), depth).tolist() == [by_bytes[p[k : k + depth]] for p in phrases for k in range(len(p) - depth + 1)]
    text = np.append(rng.integers(1, 1 + letters, 300), 0)
    assert suffix_order(text, 301).tolist() == sorted(range(301), key=lambda i: text[i:].tolist())


def test_fingerprints(spark, small, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 16)  # many ranges
    rows = sorted(((r["doc_id"] * 7 - 300, r["text"]) for r in small.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    plain = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    by_text = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = plain(t[: len(t) - half] + nxt[:half])
        by_text[plain(t)].add(got[i]["fingerprint"])
        by_text[edited].add(got[i]["edited_fingerprint"])
        assert (got[i]["near_edited"], got[i]["near_next"]) == (float(plain(t) == edited), float(plain(t) == plain(nxt)))
    assert all(len(v) == 1 for v in by_text.values()) and len({*map(tuple, by_text.values())}) == len(by_text)


def test_fingerprints_odd(spark, odd, none):
    got = fingerprint.fingerprints(odd)
    assert got.count() == odd.count() and fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "Abc d")], "doc_id long, text string")).first()
    assert (one["near_edited"], one["near_next"]) == (0.0, 1.0)


def test_clashing_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "_digest", lambda c: F.lit("same"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b"), (5, "aab"), (6, "baa")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(rows).collect()}
    texts = {1: ("a", "a"), 2: ("b", "b"), 3: ("a", "a"), 4: ("b", "b"), 5: ("aab", "aab"), 6: ("baa", "baa")}
    names = defaultdict(set)
    for i, (own, edited) in texts.items():
        names[own].add(got[i]["fingerprint"])
        names[edited].add(got[i]["edited_fingerprint"])
    assert all(len(v) == 1 for v in names.values()) and len(set.union(*names.values())) == len(names)
    assert [got[i]["near_next"] for i in (6, 5, 4, 3, 2, 1)] == [0, 0, 0, 0, 0, 0] and got[4]["near_edited"] == 1


def test_nfc(spark):
    rng = np.random.default_rng(3)
    pool = [chr(c) for c in (0x41, 0x65, 0xE9, 0xF4, 0x1EA5, 0x301, 0x300, 0x323, 0x302, 0x345, 0x3B1, 0x1F71, 0x212B, 0x2126, 0x327, 0x915, 0x93C, 0x958, 0x20, 0x9BC, 0x9BE, 0x9C7, 0x1E9B, 0xF900, 0x5D0, 0x5BC, 0x1D15E, 0x307)]
    texts = ["".join(rng.choice(pool, rng.integers(0, 9))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint.nfc(F.col("t")).alias("n")).collect()
    assert all(unicodedata.normalize("NFC", r["t"]) == r["n"] for r in got)


def test_hangul(spark):
    rng = np.random.default_rng(5)
    pool = [chr(c) for c in (0x10FF, 0x1100, 0x1112, 0x1113, 0x1160, 0x1161, 0x1175, 0x1176, 0x11A7, 0x11A8, 0x11C2, 0x11C3, 0xABFF, 0xAC00, 0xAC01, 0xAC1C, 0xD788, 0xD7A3, 0xD7B0, 0x301, 0x323, 0x65, 0x0A, 0x1F600)]
    texts = ["".join(rng.choice(pool, rng.integers(0, 9))) for _ in range(1500)] + [unicodedata.normalize("NFD", "".join(map(chr, range(0xAC00, 0xD7A4))))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint.nfc(F.col("t")).alias("n")).collect()
    assert all(unicodedata.normalize("NFC", r["t"]) == r["n"] for r in got)
    both = spark.createDataFrame([(k, unicodedata.normalize(f, "한국어 텍스트, 값")) for k, f in enumerate(("NFC", "NFD"))], "doc_id long, text string")
    assert len({r["d"] for r in both.select(fingerprint._digest(fingerprint.canonical(F.col("text"))).alias("d")).collect()}) == 1


def test_word_kernel():
    import pyarrow as pa

    texts = ["The  cat\n", None, "", "the CAT", " x"]
    data, off = bytetext.column_bytes(pa.array(texts))
    start, end, h, woff = bytetext.words(data, off)
    assert woff.tolist() == [0, 2, 2, 2, 4, 5] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert [data[s:e].tobytes() for s, e in zip(start, end, strict=True)] == [b"The", b"cat", b"the", b"CAT", b"x"]


def test_long_runs_of_marks(spark):
    """Runs of combining marks of any length: class by class beyond a bound, and in time that does not grow with their square."""
    rng = random.Random(2)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["̣", "़", "ְ", "゙"]
    texts = ["a" + "".join(rng.choice(marks) for _ in range(n)) for n in (1, 5, 63, 64, 65, 300, 100_000)]
    texts += ["ế́" + "́" * 200 + "s" + "̣" * 100 + "̇" * 90, "́" * 80 + "x", "ẹ" + "̂" * 70, "ে" + "া" * 500]
    texts += ["".join(rng.choice([*marks, *"aeiouAE ạẹ"]) for _ in range(400)) for _ in range(20)]
    began = time.monotonic()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprint.nfc(F.col("t"))).collect()]
    assert got == [unicodedata.normalize("NFC", t) for t in texts]
    assert time.monotonic() - began < 90

"""Language, toxicity, language model, packing, chats, benchmark overlaps, pages and the pipeline."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm import chat_format, decontam, html_extract, language_id, lm_score, packing, queries, sampling, toxicity
from skein.llm.tokens import encoder

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def split(frame, parts, held):
    return queries._split(frame, parts, held)


def test_language(spark, odd, none):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    rows = odd.withColumn("held_out", F.lit(False))
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(rows, odd).collect()}
    assert [by_id[i] for i in (1, 2, 3, 8)] == [("und", 0.0)] * 4 and by_id[9][0] == "de"
    assert {r["lang_pred"] for r in language_id.identify(rows, none).collect()} == {"und"}
    assert language_id.identify(none.withColumn("held_out", F.lit(False)), odd).count() == 0
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 9, 10, 11, None}


def test_unlabelled_documents_with_a_letter_stay(spark, odd):
    plain = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language_id.keep_identified(plain).collect()} == {4, 5, 6, 7, 9, 10, 11, None}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, odd.filter("lang is null"), SF).collect()} == {7}


def test_toxicity(spark, odd, none):
    got = queries.op7_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.98 and held[held.toxic == 1].predicted.mean() > 0.9
    assert all(got.predicted == (got.score >= 0.3))
    rows = odd.withColumn("held_out", F.lit(False))
    labelled = spark.createDataFrame([(i, f"you are a {'clown' if i % 2 else 'friend'} today. Nice weather number {i}.", i % 2) for i in range(60)], "doc_id long, text string, toxic int")
    mixed = spark.createDataFrame([(1, "A fine day.\nWhat a clown! Good night.", False), (2, None, False), (3, "a friend", False)], "doc_id long, text string, held_out boolean")
    by_id = {r["doc_id"]: r for r in toxicity.score(mixed, labelled).collect()}
    assert [by_id[i]["predicted"] for i in (1, 2, 3)] == [1, 0, 0]
    assert [(s["start"], s["length"]) for s in by_id[1]["offending"]] == [(12, 13)]
    assert toxicity.score(rows, labelled).count() == odd.count()
    assert {r["score"] for r in toxicity.score(rows, labelled.limit(0)).collect()} == {0.0}
    assert toxicity.score(none.withColumn("held_out", F.lit(False)), labelled).count() == 0


def test_language_model(spark, small, odd, none, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 1 << 16)
    rows = split(small, 7, 2)
    got = {r["doc_id"]: r for r in lm_score.score(rows.select("doc_id", "text", "held_out")).collect()}
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])) for r in small.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(itertools.chain.from_iterable(w for i, w in words.items() if not held[i]))
    ends = sum(not h for h in held.values())
    n, v = counts.total() + ends, len(counts) + 1
    for i, w in words.items():
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    # The score of a text is its marginal over all segmentations, under the pieces' probabilities after one round.
    path = public_tokenizers.path("piece_bpe_32k.model")
    table = spark.createDataFrame([(x.encode(), c, k) for k, (x, c) in enumerate(counts.items())], "word binary, count long, hash long")
    logp = lm_score.fit(table, path, ends)
    assert sum(math.exp(p) for p in logp) == pytest.approx(1)
    known = {p: logp[k] for k, p in enumerate(lm_score.vocabulary(path).pieces)}
    for i, w in sorted(words.items())[:40]:
        assert got[i]["score"] * math.log(10) == pytest.approx(brute_marginal("".join("▁" + x for x in w).encode(), known, logp[-257:-1]) + logp[-1])
    flagged = odd.withColumn("held_out", F.lit(True))
    assert lm_score.score(flagged).filter("score < 0 and n_known = 0").count() == odd.count()
    assert lm_score.score(none.withColumn("held_out", F.lit(False))).count() == 0


def brute_marginal(text, known, bytes_):
    """Natural log probability of a whole text, all pieces at all places, by the forward recursion in its plainest form."""
    alpha = [0.0] + [-math.inf] * len(text)
    for t in range(1, len(text) + 1):
        ways = [alpha[t - 1] + bytes_[text[t - 1]]] + [alpha[t - k] + known[text[t - k : t]] for k in range(1, min(48, t) + 1) if text[t - k : t] in known]
        alpha[t] = max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways))
    return alpha[-1]


def all_segmentations(text, known, bytes_):
    """(probability, pieces) of every way to cut a text; bytes are told apart from pieces."""
    if not text:
        yield 1.0, ()
        return
    for k in range(1, len(text) + 1):
        for name, logp in ((text[:k], known.get(text[:k])), (text[0], bytes_[text[0]] if k == 1 else None)):
            if logp is not None:
                for p, rest in all_segmentations(text[k:], known, bytes_):
                    yield p * math.exp(logp), (name, *rest)


def test_lattice():
    path = public_tokenizers.path("piece_bpe_32k.model")
    voc = lm_score.vocabulary(path)
    known, bytes_ = {p: voc.first[k] for k, p in enumerate(voc.pieces)}, voc.first[-257:-1]
    raw = [t.encode() for t in ("▁the", "▁théo", "▁" + "ab" * 20, "▁😀x", "▁representation", "▁который", "▁a", "▁" + "x" * 3000)]
    lattice = lm_score.Lattice.of(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]), voc)
    assert lattice.forward(voc.first)[lattice.last] == pytest.approx([brute_marginal(r, known, bytes_) for r in raw])
    assert sum(math.exp(p) for p in voc.first) == pytest.approx(1) and max(map(len, voc.pieces)) <= 48
    short, weight = ["▁the".encode(), "▁and".encode(), "▁é".encode()], np.array([3.0, 1.0, 2.0])
    lattice = lm_score.Lattice.of(np.frombuffer(b"".join(short), np.uint8), np.array([len(r) for r in short]), voc)
    uses, number = np.zeros(len(voc.first)), {p: k for k, p in enumerate(voc.pieces)}
    for r, w in zip(short, weight, strict=True):
        ways = list(all_segmentations(r, known, bytes_))
        total = sum(p for p, _ in ways)
        assert math.log(total) == pytest.approx(brute_marginal(r, known, bytes_)) and len({x for _, x in ways}) == len(ways)
        for p, pieces in ways:
            for x in pieces:
                uses[number[x] if isinstance(x, bytes) else len(number) + x] += w * p / total
    assert lattice.expected(voc.first, weight) == pytest.approx(uses)


def test_tokens():
    enc, rng = encoder(BPE), random.Random(1)
    texts = ["it's we'll  he'd\n\n x", "''s 's 'sun", "\n'sa b'l'll've", "  ", "", "a \n", "don't 'tis 're", "日本 語's", "a<|endoftext|>b", "'1'd2 '3", "é'sé", "a\x85b", "soft\xadhy", "x²³½ "]
    texts += ["".join(rng.choice(" \n\t'strelvmd.1aZé½-") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    ids, cut = enc.encode("".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    plain = Tokenizer.from_file(BPE)
    assert all(ids[cut[k] : cut[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts))


def test_packing(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs).toPandas()
    plain = Tokenizer.from_file(BPE)
    ids = {r["doc_id"]: [*plain.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}
    for d, rows in got.groupby("doc_id"):
        rows = rows.sort_values("piece")
        assert rows.piece.tolist() == list(range(len(rows))) and rows.length.sum() == len(ids[d]) and (rows.length[1:] == 2048).all() and rows.length.max() <= 2048
        for r in rows.itertuples():
            assert zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == np.concatenate(([0], np.cumsum(rows.length)[:-1])).tolist() and rows.length.sum() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 2
    odd_rows = packing.pack(odd).toPandas()
    assert odd_rows[odd_rows.doc_id.isin([1, 2])].length.tolist() == [1, 1] and len(odd_rows[odd_rows.piece == 0]) == odd.count()
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    for n in rng.integers(1, 65, [3, 50, 400, 2000][seed]):
        counts[n] += rng.integers(1, 50)
    used = np.zeros(65, np.int64)
    plan = packing.plan_packing(counts, 64)
    for times, bag in plan:
        assert sum(k * n for k, n in bag.items()) <= 64
        for k, n in bag.items():
            used[k] += times * n
    assert (used == counts).all()
    bound = math.ceil((counts * np.arange(65)).sum() / 64)
    assert sum(t for t, _ in plan) <= max(bound * 1.1 + 1, counts[33:].sum() + 1)


def test_chats(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    ours, theirs = queries.op6_chat_format(spark, SF).toPandas(), con.sql(queries.ORACLE["op6_chat_format"]).df()
    order = sorted(ours.columns)
    assert ours[order].sort_values("conv_id").astype(str).to_numpy().tolist() == theirs[order].sort_values("conv_id").astype(str).to_numpy().tolist()
    rng, bits = random.Random(5), ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", " ", "\n", "ok", "<\\s>", "[\\\\INST]", "s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "a [/INST]", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))) for c in range(300) for t in range(rng.randint(1, 4))]
    rows += [(None, None, "user", None), (900, 1, "assistant", "x" * 300_000), (900, 1, "assistant", "x" * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS rows")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.format_chats(frame).collect()}
    for c in {r[0] for r in rows}:
        assert got[c] == [(r or "", x or "") for _, r, x in sorted(((t or 0, r or "", x or "") for k, t, r, x in rows if k == c))]
    assert chat_format.digests(chat_format.format_chats(frame.limit(0))).count() == 0


def test_overlaps(spark, odd, none):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    item = [word() for _ in range(40)]
    swapped = [word() if k % 9 == 4 else w for k, w in enumerate(item)]
    fill = lambda n: [word() for _ in range(n)]
    docs = [(1, fill(30) + item + fill(9)), (2, fill(5) + swapped), (3, item[10:25] + fill(50)), (4, fill(200)), (5, item[:9] + fill(30)), (6, [w.upper() + "," for w in item]), (7, fill(20) + item[30:38] + fill(3))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, " ".join(fill(8))), (4, None), (5, "of the"), (9, " ".join(item[30:38]))], "item_id long, text string")
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["start_word"]) for r in decontam.contaminated(frame, bench).collect()}
    assert {d for d, i in got if i == 1} == {1, 2, 3, 6} and {d for d, i in got if i == 9} == {1, 2, 6, 7} and got[1, 1] == (40, 30)
    assert {i for _, i in got} == {1, 2, 9} and all(got[d, 2] == got[d, 1] for d, i in got if i == 2)
    assert [r["doc_id"] for r in decontam.decontaminate(frame, bench).collect()] == [4, 5]
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.decontaminate(odd, bench).columns == odd.columns
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(frame, bench.limit(0)).count() == 0


def test_overlaps_do_not_depend_on_the_filter(spark, monkeypatch):
    """A filter that is full lets every document into the join and changes nothing."""
    whole = {tuple(r) for r in queries.op9_decontaminate(spark, SF).collect()}
    monkeypatch.setattr(decontam, "FILTER_BITS", 10)
    assert {tuple(r) for r in queries.op9_decontaminate(spark, SF).collect()} == whole and whole


def test_overlaps_of_a_hot_passage(spark, odd):
    """Many items share a passage, copies of a text repeat it; items of equal words are reported each, null ids and texts stand."""
    shared = " ".join(f"s{k}" for k in range(15))
    bench = spark.createDataFrame([*((k, f"{shared} own{k // 2}") for k in range(200)), (None, "a b c d e f g"), (500, None)], "item_id long, text string")
    docs = [*((d, " x ".join([shared] * 20)) for d in range(50)), (None, shared), (60, "A, b c d e f g"), (61, "s0 s1 s2"), (62, None), (62, shared), (62, shared)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS text_key", "1 AS lost", "2 AS item_id")
    got = [(r["doc_id"], r["item_id"], r["matched"], r["start_word"]) for r in decontam.contaminated(frame, bench).collect()]
    expected = [(d, i, 15, 0) for d in (*range(50), None, 62, 62) for i in range(200)] + [(60, None, 7, 0)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == {(61, "s0 s1 s2"), (62, None)}
    assert decontam.decontaminate(odd, bench).count() == odd.count()


def brute_overlap(doc, item):
    """Whether some diagonal's best segment (+1 / -2, first end, first begin) counts."""
    need = len(item) if len(item) < 6 else min(13, math.ceil(0.75 * len(item)))
    for shift in range(1 - len(item), len(doc)):
        a, b = max(0, shift), min(len(doc), shift + len(item))
        gain = [0, *itertools.accumulate(1 if doc[k] == item[k - shift] else -2 for k in range(a, b))]
        least = list(itertools.accumulate(gain, min))
        top = max(range(len(gain)), key=lambda k: (gain[k] - least[k], -k))
        begin = gain.index(least[top])
        if sum(doc[a + k] == item[a + k - shift] for k in range(begin, top)) >= need:
            return True
    return False


def test_overlaps_miss_nothing(spark):
    """Each way to substitute words of a short item, and random ways for longer ones, against the rule itself."""
    rng = random.Random(4)
    bench, docs, expected = [], [], set()
    for size in (*range(1, 16), 17, 18, 20, 25, 40):
        item = [f"a{size}z{k}" for k in range(size)]
        bench.append((size, " ".join(item)))
        ways = [gone for n in range(3) for gone in itertools.combinations(range(size), n)] if size < 16 else []
        ways += [rng.sample(range(size), rng.randint(0, size // 2)) for _ in range(300)]
        ways += [[*range(0, size, 3)], [*range(2, size, 3)], [k for k in range(2, size - 3, 3)], [*range(0, size - 13)], [*range(13, size)]]
        for gone in ways:
            doc = ["x", *("y" if k in gone else w for k, w in enumerate(item)), "z"]
            if brute_overlap(doc, item):
                expected.add((len(docs), size))
            docs.append((len(docs), " ".join(doc)))
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, items).collect()} == expected


def test_overlaps_of_short_items_and_of_scripts_without_spaces(spark):
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "日本の首都はどこですか"), (3, "!?"), (4, "𠀀𠀁")], "item_id long, text string")
    docs = [(1, "so who wrote, Hamlet"), (2, "who wrote of Hamlet"), (3, "問い：日本の首都はどこですか。東京です"), (4, "日本の首都"), (5, "x𠀀𠀁y"), (6, "𠀁𠀀"), (7, "who"), (7, "wrote Hamlet")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"], r["start_word"]) for r in decontam.contaminated(frame, bench).collect()}
    assert got == {(1, 1, 3, 1), (3, 2, 11, 3), (5, 4, 2, 1)}
    assert [r["doc_id"] for r in decontam.decontaminate(frame, bench).collect()] == [2, 4, 6, 7, 7]


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    for r in queries.op10_html_extract(spark, SF).collect():
        inside = re.search(r"<article>(.*)</article>", pages.loc[r["page_id"]].html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"]) and r["url"] == pages.loc[r["page_id"]].url


PAGE = """<html><head><title>T</title></head><body><header class="top">Site name here</header><ul class="menu"><li><a href=x>One</a><li><a>Two</a></ul>
<main><h1>Title &amp; more</h1><div class="share-buttons">Share this</div><p>First <b>bold</b>ed   text that is long enough to be the content of a page.
<p>Second paragraph, which has many words as well, so that it counts &lt;here&gt;.<ul><li>item one of a list<li>item two of a list</ul>
<form><label>Mail</label><input></form><script>if (a < b) { var x = "<p>no</p>"; }</script><p>Third one ends it with a few more words.</p></main>
<section id="comments"><p>Reader: I like it very much indeed, a lot of words are in here too.</p></section><aside>side words</aside><footer>&copy; 2024</footer>"""


def test_page_parts(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words only, no tags"), (5, "u", "<p>open <b>tag"), (5, "u", "<p>open <b>tag"), (6, "u", "<" * 50 + "<!-- never closed"), (7, "u", "<article><p>" + "word " * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(frame).collect()}
    assert got[1].split("\n") == [
        "Title & more", "First bolded text that is long enough to be the content of a page.", "Second paragraph, which has many words as well, so that it counts <here>.",
        "item one of a list", "item two of a list", "Third one ends it with a few more words.",
    ]
    assert got[2] == got[3] == "" and got[4] == "plain words only, no tags" and got[5] == "open tag" and len(got[7]) == 499_999
    assert html_extract.main_text(frame.limit(0)).count() == 0


def test_names_that_articles_use(spark):
    long = "which is a paragraph of prose with quite a few more words in it"
    article = f"""<nav>go home</nav><article><h1>A title of quite a few words</h1><p>First, {long}.</p><h2 id="related-work">Related work</h2><p>Second, {long}.</p>
<h2 class="search">Search</h2><section id="discussion"><p>Third, {long}.</p></section><div class="legal"><p>Fourth, {long}.</p></div><p data-id="ad" title="id=ad">Fifth, {long}.</p><div class="notice">Log in</div><section id="comments"><p>Reader, {long}.</p></section></article>"""
    wrapped = f"<h1>A title of quite a few words</h1><p>First, {long}.</p><div class='ad'>Buy now</div><div class='search'>Find it</div><p>Second, {long}.</p>"
    pages = {1: article, 2: f"<body><form id=all>{wrapped}</form></body>", 3: f"<div class='content with-sidebar has-comments'>{wrapped}</div>", 4: f"<div role=search>Find</div><p>First, {long}.</p>"}
    frame = spark.createDataFrame([(k, "u", v) for k, v in pages.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in html_extract.main_text(frame).collect()}
    prose = lambda *names: [f"{n}, {long}." for n in names]
    assert got[1] == ["A title of quite a few words", *prose("First"), "Related work", *prose("Second"), "Search", *prose("Third", "Fourth", "Fifth")]
    assert got[2] == got[3] == ["A title of quite a few words", *prose("First", "Second")] and got[4] == prose("First")


SHAPES = {
    "link": lambda a: re.sub(r"<p>(\S+) (\S+)", r'<p>\1 <a href="/x">\2</a>', a),
    "list": lambda a: re.sub(r"<p>(.*?)</p>", lambda m: "<ul>" + "".join(f"<li>{x}</li>" for x in re.split(r"(?<=\.) ", m[1])) + "</ul>", a, flags=re.S),
    "division": lambda a: re.sub(r"<p>(.*?)</p>", r"<div>\1</div>", a, flags=re.S),
    "heading": lambda a: a.replace("<p>", "<h2>Some part</h2><p>"),
    "table": lambda a: re.sub(r"<p>(.*?)</p>", r"<table><tr><td>\1</td></tr></table>", a, flags=re.S),
    "unmarked": lambda a: a,
}


@pytest.mark.parametrize("prior", [True, False])
@pytest.mark.parametrize("shape", SHAPES)
def test_articles_of_other_shapes(shape, prior):
    """Weights of given pages, with and without names that begin below zero, on other pages whose articles were rebuilt: the words of the article, and no others."""
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()]
    counts: Counter = Counter()
    for page in pages[:150]:
        counts += html_extract.count(page)
    weights, found = html_extract.Weights(counts, prior), []
    for page in pages[150:]:
        before, article, after = re.split(r"<article>|</article>", page)
        article = SHAPES[shape](article)
        words = [w for x in re.split(r"</?(?:p|h1|h2|li|ul|div|table|tr|td)\b[^>]*>", article) for w in html.unescape(re.sub(r"<[^>]+>", "", x)).split()]
        for mark in ("div", "article"):
            got = html_extract.extract(f"{before}<{mark}>{article}</{mark}>{after}", weights).split()
            found.append(2 * sum((Counter(words) & Counter(got)).values()) / (len(words) + len(got)))
    assert np.mean(found) > 0.95


def test_weights_and_the_scan_decide():
    """Learned weights find the articles of pages that they were not fitted to, without any list as well; uniform ones do not."""
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()]
    counts: Counter = Counter()
    for page in pages[:100]:
        counts += html_extract.count(page)
    rest = pages[100:]
    learned, bare, uniform = ([html_extract.extract(p, w) for p in rest] for w in (html_extract.Weights(counts), html_extract.Weights(counts, prior=False), html_extract.Uniform()))
    for page, own, plain, all_ in zip(rest, learned, bare, uniform, strict=True):
        words = html.unescape(re.sub(r"<[^>]+>", " ", re.search(r"<article>(.*)</article>", page, re.S)[1])).split()
        assert own.split() == words and all_ != own
        assert 2 * sum((Counter(words) & Counter(plain.split())).values()) >= 0.98 * (len(words) + len(plain.split()))
    # The run ends where an unnamed block of few words follows, though each of its words scores above zero by itself.
    weights = html_extract.Weights(Counter())
    text = "<div><h1>Some title</h1>" + "<p>A paragraph of prose with more than ten words in it, as here.</p>" * 3 + "</div>"
    page = html_extract.Page(f"{text}<ul><li>One</li></ul><ul><li>Two</li></ul>")
    score = html_extract.scores(page, weights)
    _, end = html_extract.region(score)
    assert end < len(score) and all(s > 0 for s, n in zip(score, page.words, strict=True) if n) and sum(page.words[end:]) == 2


@pytest.mark.parametrize("page", ["<ul><li><ol>" + "<b>" * 80_000 + "<li></li>" * 80_000, "".join(f"<div class=c{k}>" for k in range(50_000)), "<a " * 200_000, '<a "' * 100_000 + ">", "<div>" * 100_000, "<!--" * 100_000, "<script " * 100_000, "<x '>'" * 100_000, "<p><b>" * 50_000, "<" * 200_000 + ">"])
def test_odd_markup_is_read_in_linear_time(page):
    weights, began = html_extract.Weights(Counter()), time.process_time()
    html_extract.extract(page, weights)
    assert time.process_time() - began < 10


def test_pipeline(spark, odd):
    """Each stage against a plain version on what the stage before it kept."""
    from .test_dedup import brute_components, brute_repeats

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.stage(step(spark, docs, SF), name)
        if name == "pack":
            break
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "language":
            assert set(after) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r["text"])}
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in brute_components([(i, r["text"]) for i, r in before.items()]).items() if i == c}
        elif name == "repeats":
            expected = brute_repeats([(i, r["text"]) for i, r in before.items()])
            for i, r in after.items():
                size, removed, *_ = expected[i]
                assert abs(len(r["text"].encode()) - (size - removed)) <= 6 * expected[i][2] and (removed or r["text"] == before[i]["text"])
        else:
            flat = {i: " ".join(re.findall(r"\w+", r["text"].lower())) for i, r in before.items()}
            whole = {i for i, t in flat.items() if any(" ".join(re.findall(r"\w+", b.lower())) in t for b in bench)}
            assert whole and whole <= set(before) - set(after) and len(before) - len(after) <= len(whole) + 3
    packed = docs.toPandas()
    assert set(packed.doc_id) == set(after) and packed.groupby("sequence_id").length.sum().max() <= 2048
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, odd, SF).columns == odd.columns, name
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_samples_are_bounded_in_rows(spark):
    """One doc_id repeated many times does not bring all its rows into a sample, whatever its labels."""
    rows = spark.range(100_000).selectExpr("7L AS doc_id", "if(id % 2 = 0, 'a', 'b') AS label").union(spark.range(100, 400).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS label"))
    rows = rows.union(spark.range(40).selectExpr("8L AS doc_id", "'a' AS label")).union(spark.range(5).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'a' AS label"))
    ids = sampling.sample(rows, "label", 50)
    taken = rows.join(ids, ["doc_id", "label"], "left_semi").groupBy("label").count().collect()
    assert {r["label"] for r in taken} == {"a", "b"} and all(0 < r["count"] <= 50 for r in taken)
    every = sampling.sample(spark.range(30).selectExpr("id AS doc_id", "'a' AS label"), "label", 50)
    assert every.count() == 30

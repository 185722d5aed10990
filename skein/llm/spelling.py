"""Spelling variants: each word's neighbours at distance one, found by Levenshtein automata over shards of a trie.

The vocabulary is dealt by ranges into shards of bounded size, each a compact trie.  Shards are broadcast block by block,
so that what passes through the driver is bounded however many words there are.  Every word meets every shard: the
automaton of distance one runs down the trie depth-first, many words at a time, and dies near the root of a shard that
holds nothing like the word.  A task hands on a word's number of neighbours and its best one in the block; blocks are
reduced by word, and forms are followed to their last by pointer doubling.

Defined results: null and empty texts have no words, a null doc_id counts as an empty one, repeated rows count each,
an empty table gives no row; a word of any length is a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Words and code points of one shard, and code points of the shards that are broadcast together.
SHARD_WORDS, SHARD_POINTS, BLOCK_POINTS = 1 << 17, 1 << 20, 1 << 22
#: Edges that one step of the walk holds, about; more are split and put on the stack. A state without an error looks at so many.
HELD, EDGES = 1 << 17, 32
#: One deletion in so many runs, chosen by CRC-32.
DELETED = 31
_SHIFT = np.int64(21)  # bits of a code point


def count_words(docs: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n): letter runs of ``docs`` (doc_id, text), lower-cased in A-Z, one code point deleted where the checksum of
    document and run says so; words of at least ``shortest`` code points seen at least ``least`` times."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = runs.withColumn("h", h).select(F.when(F.col("h") % DELETED == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points, and where each word starts and how many it has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return points, np.cumsum(size) - size, size


def build_trie(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(edges, ends) of distinct words in order of their code points.

    Edge j, node << 21 | code point, leads to node j + 1, and edges are in order; the root is node 0.  ``ends`` has the
    number of the word that ends in a node, or -1.
    """
    points, start, size = code_points(words)
    shared = np.zeros(len(words) + 1, np.int64)  # leading code points in common with the word before
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared[i] = k
    edges, ended, node, made, alive = [], [], np.zeros(len(words), np.int64), 0, np.flatnonzero(size > 0)
    for d in range(int(size.max(initial=0))):
        fresh = np.ones(len(alive), bool)
        if len(alive) > 1:  # the same node as the word before that is long enough, if all in between share d + 1 points
            fresh[1:] = np.minimum.reduceat(shared[: alive[-1] + 1], alive[:-1] + 1) <= d
        edges.append(node[alive[fresh]] << _SHIFT | points[start[alive[fresh]] + d])
        node[alive] = made + np.cumsum(fresh)
        made += int(fresh.sum())
        over = size[alive] == d + 1
        ended.append(alive[over])
        alive = alive[~over]
    ends = np.full(made + 1, -1, np.int32)
    ends[0] = 0 if words and not words[0] else -1
    for which in ended:
        ends[node[which]] = which
    return np.concatenate(edges) if edges else np.zeros(0, np.int64), ends


#: A shard as a row: its words in order, their counts, and the trie.
SHARD = "first string, points long, words array<string>, counts array<long>, edges binary, ends binary"


def _build_shards(most_words: int, most_points: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards of the words of one range, which come in order."""
    words: list[str] = []
    counts: list[int] = []
    points = 0

    def shard() -> pd.DataFrame:
        edges, ends = build_trie(words)
        return pd.DataFrame([(words[0], points, words, counts, edges.tobytes(), ends.tobytes())], columns=["first", "points", "words", "counts", "edges", "ends"])

    for frame in frames:
        for word, n in zip(frame["word"], frame["n"], strict=True):
            if words and (len(words) >= most_words or points + len(word) > most_points):
                yield shard()
                words, counts, points = [], [], 0
            words.append(word)
            counts.append(n)
            points += len(word)
    if words:
        yield shard()


class Shard:
    """A shard as an executor uses it."""

    def __init__(self, row: dict) -> None:
        self.words, self.counts = row["words"], row["counts"]
        self.edges, self.ends = np.frombuffer(row["edges"], np.int64), np.frombuffer(row["ends"], np.int32)
        self.children = np.searchsorted(self.edges, np.arange(len(self.ends) + 1, dtype=np.int64) << _SHIFT).astype(np.int32)

    def child(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The node below by a code point, or 0."""
        key = node << _SHIFT | point
        at = np.searchsorted(self.edges, key)
        at[at == len(self.edges)] = 0
        return np.where(self.edges[at] == key, at + 1, 0)


#: The automaton of a word after d code points of a trie's path: at d of the word without an error, or with one
#: at d - 1 (the path has a point more), at d (a point replaced), at d + 1 (the word has a point more).
EXACT, MORE, REPLACED, LESS = 1, 2, 4, 8


def neighbours(words: list[str], shard: Shard, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): word i and the shard's word j differ by exactly one code point inserted, deleted or replaced.

    The intersection of each word's automaton with the trie, depth-first over blocks of states from a stack.  A word has
    one state at a node, so that none is met twice.
    """
    points, start, size = code_points(words)
    points = np.append(points, -1)

    def point(word: np.ndarray, at: int) -> np.ndarray:
        """The words' code points at a place, -1 outside."""
        inside = (at >= 0) & (size[word] > at)
        return np.where(inside, points[np.where(inside, start[word] + at, 0)], -1)

    left, right = [], []
    n = len(words)
    stack = [(0, np.arange(n), np.zeros(n, np.int64), np.full(n, EXACT, np.int8))]
    while stack:
        d, word, node, state = stack.pop()
        if len(word) > 1 and len(word) + EDGES * np.count_nonzero(state & EXACT) > held:
            half = len(word) // 2
            stack += [(d, word[half:], node[half:], state[half:]), (d, word[:half], node[:half], state[:half])]
            continue
        end = shard.ends[node]
        rest = size[word] - d
        good = (end >= 0) & ((rest == 1) & (state & (EXACT | LESS) > 0) | (rest == 0) & (state & REPLACED > 0) | (rest == -1) & (state & MORE > 0))
        if good.any():
            left.append(word[good])
            right.append(end[good])
        before, here, after = point(word, d - 1), point(word, d), point(word, d + 1)
        parts = []
        # Where there was no error, every edge may be one.
        at = np.flatnonzero(state & EXACT)
        lo, many = shard.children[node[at]], shard.children[node[at] + 1] - shard.children[node[at]]
        of = np.repeat(at, many)
        edge = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        c = shard.edges[edge] & ((1 << 21) - 1)
        same, old = c == here[of], state[of]
        new = MORE | np.where(same, EXACT | (old & REPLACED), np.where(here[of] >= 0, REPLACED, 0)) | np.where(c == after[of], LESS, 0)
        parts.append((word[of], edge + 1, new.astype(np.int8)))
        # After an error only the word's own points go on: at most three, each once.
        at = np.flatnonzero(~(state & EXACT) & 1)
        todo = state[at]
        for c, bit in ((before[at], MORE), (here[at], REPLACED), (after[at], LESS)):
            wanted = np.flatnonzero((todo & bit > 0) & (c >= 0))
            i, p = at[wanted], c[wanted]
            below = shard.child(node[i], p)
            new = (todo[wanted] & MORE) * (before[i] == p) | (todo[wanted] & REPLACED) * (here[i] == p) | (todo[wanted] & LESS) * (after[i] == p)
            todo[wanted] &= ~new
            found = below > 0
            parts.append((word[i[found]], below[found], new[found].astype(np.int8)))
        following = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(following[0]):
            stack.append((d + 1, *following))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


NEAR = "word string, n_near long, best_n long, best string"


def _search(shards: Broadcast, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each word that has neighbours in the block: how many, and the best (largest count, then smallest word)."""
    block = [Shard(row) for row in shards.value]
    for frame in frames:
        words = frame["word"].tolist()
        found = [neighbours(words, shard) for shard in block]
        i = np.concatenate([x for x, _ in found])
        if not len(i):
            continue
        shard = np.repeat(np.arange(len(block)), [len(x) for x, _ in found])
        j = np.concatenate([y for _, y in found]).astype(np.int64)
        n = np.concatenate([s.counts[y] for s, (_, y) in zip(block, found, strict=True)])
        order = np.lexsort((j, shard, -n, i))  # shards and their words are in order
        first = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))]
        yield pd.DataFrame({
            "word": [words[k] for k in i[first]], "n_near": np.bincount(i, minlength=len(words))[i[first]],
            "best_n": n[first], "best": [block[s].words[k].as_py() for s, k in zip(shard[first].tolist(), j[first].tolist(), strict=True)],
        })


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``vocabulary`` (word, n; words distinct) that has a neighbour."""
    spark = vocabulary.sparkSession
    total = vocabulary.agg(F.sum(F.length("word").cast("long")).alias("points"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-int(total["points"] or 0) // SHARD_POINTS), -(-total["n"] // SHARD_WORDS))
    shards = stage(vocabulary.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInPandas(partial(_build_shards, SHARD_WORDS, SHARD_POINTS), SHARD), "shards")
    # The sizes of shards only; a block holds one shard at least.
    blocks: list[list[str]] = []
    room = 0
    for row in shards.select("first", "points").orderBy("first").toLocalIterator():
        if not blocks or room < row["points"]:
            blocks.append([])
            room = BLOCK_POINTS
        blocks[-1].append(row["first"])
        room -= row["points"]
    words = vocabulary.select("word").repartition(max(parts, spark.sparkContext.defaultParallelism), "word")
    found = []
    for firsts in blocks:
        rows = shards.filter(F.col("first").between(firsts[0], firsts[-1])).orderBy("first").toArrow().to_batches(1)
        # Copies, as a slice would be sent with all that it is a slice of.
        block = [{"words": pa.concat_arrays([r["words"][0].values]), "counts": r["counts"][0].values.to_numpy().copy(), "edges": r["edges"][0].as_py(), "ends": r["ends"][0].as_py()} for r in rows]
        shared = spark.sparkContext.broadcast(block)
        del rows, block
        found.append(stage(words.mapInPandas(partial(_search, shared), NEAR), "near"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], NEAR)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.order")).alias("best_n"), F.col("_b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): ``links`` (word, form; words distinct, no cycle) followed to the last form, by pointer doubling."""
    at = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        both = at.join(further, at["root"] == F.col("_from"), "left")
        if both.filter("_to is not null").isEmpty():
            return at
        at = stage(both.select("word", F.coalesce("_to", "root").alias("root")), "roots")


def variants(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    A word's form is its neighbour of the largest n, the smallest of these words, if that n is at least ``times`` the
    word's own; the root is what forms lead to, so that all spellings of a root are a group.
    """
    if times < 2:
        raise ValueError("a form has to be more frequent than its word")
    known = near_words(vocabulary)
    formed = F.col("best_n") >= times * F.col("n")
    forms = vocabulary.join(known, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    forms = stage(forms, "forms")
    last = roots(forms.filter("form is not null").select("word", "form"))
    return forms.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """The spelling variants of the words of ``docs`` (doc_id, text)."""
    return variants(stage(count_words(docs), "vocabulary"))

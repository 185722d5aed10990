"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, A-Z lower-cased; in scripts that put no space between words, each character is a
word.  Masks pick some of the words in a window and ignore the others, so a substituted word does not hide a passage.
Hashes of the picked words of all benchmark items are joined to those of every document; around a hit, the item is laid
over the document and the best substitution-tolerant overlap is measured (one for an equal word, minus two for another).
An overlap counts with ``MATCHED`` equal words, or with three quarters of a shorter item's.

The masks follow from this rule and miss no overlap that counts: the best overlap ends at its first highest sum, so each
of its ends sums to more than zero, and read from the end n equal words come with fewer than n / 2 substitutions.  All
ways in which its last ``SEED`` equal words (fewer for an item that needs fewer) can lie under that bound are looked up.

The benchmark is a table of any size and stays one: items of equal words are compared once, their seeds are rows, and seeds meet
by a join.  Only a bit filter of the seeds travels to the tasks that scan the documents, of ``2 ** FILTER_BITS`` bits at
most; a fuller one lets more documents into the join and changes no result.  Documents stay where they are: only words
and hits of those that may hold a seed are written, equal texts once.

Defined results: items of fewer than six words match where all their words follow each other, items without a word
match nothing; items with equal words are compared once and reported each; null or empty texts contain nothing; rows that share a doc_id are
compared each; an empty table on either side gives no overlaps; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import mix, prefix_hash, span_hash, text_slices
from .staging import stage

#: Fixed value: so many equal words are compared at most in a window.
SEED = 7
MATCHED, SHORTEST, SHARE, MISMATCH = 13, 6, 0.75, 2
#: Bits of the filter for each seed and at most (as a power of two: 16 MB), and places that a seed sets there.
SPREAD, FILTER_BITS, PROBES = 128, 27, 4
#: Digests of so many contaminated texts are broadcast at most; beyond it they meet the documents by a shuffle.
BROADCAST_TEXTS = 1_000_000
_HITS = "doc_id long, text_key string, words array<long>, hits array<struct<mask: int, at: int, seed: long>>"
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Scripts without spaces between words (Thai to Tibetan, Myanmar, Khmer, Kana and Bopomofo, Han, Yi, half-width Kana, Han beyond 16 bits).
_ALONE = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def endings(n: int) -> list[str]:
    """Every mask of the last ``n`` equal words that an overlap can end in: before its (k + 1)-th from the end, k > ``MISMATCH`` times the substitutions."""
    found = [("1", 0)]
    for k in range(1, n):
        found = [("1" + "0" * more + mask, gone + more) for mask, gone in found for more in range((k - 1) // MISMATCH - gone + 1)]
    return [mask for mask, _ in found]


def needed(size: int) -> int:
    """Equal words that make an overlap with an item of ``size`` words count."""
    return size if size < SHORTEST else min(MATCHED, math.ceil(SHARE * size))


def _alone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each character that is a word of its own."""
    wide = np.flatnonzero(data >= 0xE0)
    b = [data[np.minimum(wide + k, len(data) - 1)].astype(np.int64) for k in range(4)]
    far = b[0] >= 0xF0
    cp = np.where(far, ((b[0] & 7) << 18) | ((b[1] & 63) << 12) | ((b[2] & 63) << 6) | (b[3] & 63), ((b[0] & 15) << 12) | ((b[1] & 63) << 6) | (b[2] & 63))
    own = np.zeros(len(wide), bool)
    for lo, hi in _ALONE:
        own |= (cp >= lo) & (cp <= hi)
    return wide[own], wide[own] + 3 + far[own]


def plain_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and word offsets of the rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    ink = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, end = _alone(data)
    edge[first] = edge[end] = True
    start = np.flatnonzero(ink & (edge[:n] | np.concatenate(([True], ~ink[:-1]))))
    end = np.flatnonzero(ink & (edge[1:] | np.concatenate((~ink[1:], [True])))) + 1
    return span_hash(prefix_hash(_LOWER[data]), start, end), np.searchsorted(start, off)


def seeds(h: np.ndarray, woff: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a mask's windows that lie in one row."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(len(mask)))
    for j, c in enumerate(mask):
        if c == "1":
            acc = acc * _STEP + h[j : j + n]
    row_end = np.repeat(woff[1:], np.diff(woff))[:n]
    at = np.flatnonzero(np.arange(n) + len(mask) <= row_end)
    return at, mix(acc[at])


#: Every mask with the items it serves: words looked up, whether they are whole items under SHORTEST words, mask.
MASKS = [(n, True, "1" * n) for n in range(1, SHORTEST)]
MASKS += [(n, False, mask) for n in sorted({min(SEED, needed(size)) for size in range(SHORTEST, 2 * SEED)}) for mask in endings(n)]


def _lists(values: pa.Array, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, data, off in text_slices(batches):
        h, woff = plain_words(data, off)
        keys = [hashlib.md5(h[a:b].tobytes()).hexdigest() for a, b in zip(woff[:-1], woff[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(keys, pa.string()), _lists(pa.array(h.view(np.int64)), woff)], ["item_id", "item", "of_item"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        woff = np.concatenate(([0], np.cumsum(size)))
        h = batch.column(1).flatten().to_numpy().view(np.uint64)
        whole = size < SHORTEST
        weight = np.array([n if n < SHORTEST else min(SEED, needed(n)) for n in size.tolist()], np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        for k, (n, short, mask) in enumerate(MASKS):
            at, s = seeds(h, woff, mask)
            own = (weight[owner[at]] == n) & (whole[owner[at]] == short)
            at, s = at[own], s[own]
            place = (at - woff[owner[at]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(s.view(np.int64)), batch.column(0).take(pa.array(owner[at])), pa.array(place)], ["mask", "seed", "item", "place"])


def seed_filter(table: DataFrame) -> np.ndarray:
    """A bit filter of all seeds, as words of 64 bits: aggregated on the executors, of a bounded number of words."""
    bits = 1 << min(FILTER_BITS, max(16, (SPREAD * table.count()).bit_length()))
    probes = F.array(*[F.shiftrightunsigned("seed", 12 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)])
    places = table.select(F.explode(probes).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63L as int))").alias("bit"))
    words = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _may_hold(filt: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where ``s`` has seeds that the filter lets through."""
    left = np.arange(len(s))
    for k in range(PROBES):
        at = (s[left] >> np.uint64(12 * k)) & np.uint64((len(filt) << 6) - 1)
        left = left[(filt[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1]
    return left


def _hits(filt: np.ndarray, masks: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and hits of the rows that may hold a seed."""
    for batch, lo, _, data, off in text_slices(batches):
        h, woff = plain_words(data, off)
        found = []
        for k in masks:
            at, s = seeds(h, woff, MASKS[k][2])
            some = _may_hold(filt, s)
            found.append((np.full(len(some), k, np.int32), at[some], s[some]))
        mask, at, s = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(at):
            continue
        order = np.argsort(at, kind="stable")
        mask, at, s = mask[order], at[order], s[order]
        row = np.searchsorted(woff, at, "right") - 1
        rows = np.unique(row)
        hits = pa.StructArray.from_arrays([pa.array(mask), pa.array((at - woff[row]).astype(np.int32)), pa.array(s.view(np.int64))], ["mask", "at", "seed"])
        words = np.concatenate([h[woff[r] : woff[r + 1]] for r in rows]).view(np.int64)
        keys = [hashlib.md5(data[off[r] : off[r + 1]].tobytes()).hexdigest() for r in rows]
        size = np.concatenate(([0], np.cumsum(np.diff(woff)[rows])))
        hit_off = np.concatenate((np.searchsorted(row, rows), [len(row)]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + rows)), pa.array(keys, pa.string()), _lists(pa.array(words), size), _lists(hits, hit_off)], ["doc_id", "text_key", "words", "hits"])


def _step(acc: Column, same: Column) -> Column:
    """One word further on a diagonal: the segment that ends here, and the first best one so far."""
    run = acc["run"] + F.when(same, 1).otherwise(-MISMATCH)
    lost = run < 0
    run, start = F.when(lost, 0).otherwise(run), F.when(lost, acc["at"] + 1).otherwise(acc["start"])
    equal = F.when(lost, 0).otherwise(acc["equal"] + same.cast("int"))
    better = run > acc["best"]
    pick = [F.when(better, new).otherwise(acc[name]).alias(name) for name, new in (("best", run), ("matched", equal), ("begin", start))]
    return F.struct((acc["at"] + 1).alias("at"), run.alias("run"), start.alias("start"), equal.alias("equal"), *pick)


def _best_overlaps(pairs: DataFrame) -> DataFrame:
    """(text_key, item, matched, item_words, start_word): the best counting overlap of each text and item.

    ``pairs`` has words of a text and of an item, and how far the item is shifted over the text; equal overlaps go by the least shift.
    """
    n, first = F.size("of_item"), F.greatest("shift", F.lit(0))
    size = F.least(F.size("words"), F.col("shift") + n) - first
    same = F.zip_with(F.slice("words", first + 1, size), F.slice("of_item", first - F.col("shift") + 1, size), lambda x, y: x == y)
    zero = F.struct(*[F.lit(0).alias(name) for name in ("at", "run", "start", "equal", "best", "matched", "begin")])
    laid = pairs.select("text_key", "item", "shift", first.alias("first"), n.alias("item_words"), F.aggregate(same, zero, _step).alias("o"))
    enough = F.when(F.col("item_words") < SHORTEST, F.col("item_words")).otherwise(F.least(F.lit(MATCHED), F.ceil(F.col("item_words") * SHARE)))
    order = F.struct((-F.col("o.matched")).alias("less"), "shift", (F.col("first") + F.col("o.begin")).alias("start_word"), "item_words")
    best = laid.filter(F.col("o.matched") >= enough).groupBy("text_key", "item").agg(F.min(order).alias("b"))
    return best.select("text_key", "item", (-F.col("b.less")).alias("matched"), "b.item_words", "b.start_word")


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_key) of the rows that may overlap, the overlaps of their texts with items, and (item, item_id); a text's key is its MD5, an item's its words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = stage(rows.mapInArrow(_item_words, "item_id long, item string, of_item array<long>").filter(F.size("of_item") > 0), "items")
    items = stage(known.groupBy("item").agg(F.first("of_item").alias("of_item")), "kinds")
    table = stage(items.select("item", "of_item").mapInArrow(_item_seeds, "mask int, seed long, item string, place int"), "seeds")
    masks = sorted(r["mask"] for r in table.select("mask").distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(texts.mapInArrow(partial(_hits, seed_filter(table), masks), _HITS) if masks else docs.sparkSession.createDataFrame([], _HITS), "hits")
    texts = stage(found.groupBy("text_key").agg(F.first("words").alias("words"), F.first("hits").alias("hits")), "texts")
    hits = texts.select("text_key", F.explode("hits").alias("hit")).select("text_key", "hit.*")
    shifts = hits.join(table, ["mask", "seed"]).select("text_key", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = shifts.join(items, "item").join(texts.select("text_key", "words"), "text_key")
    return found.select("doc_id", "text_key"), _best_overlaps(pairs), known.select("item", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, item_words, start_word for each pair of a document and an item that overlap, items of equal words each."""
    rows, overlaps, members = _overlaps(docs, benchmark)
    return rows.join(overlaps.join(members, "item"), "text_key").select("doc_id", "item_id", "matched", "item_words", "start_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item; all columns stay, and up to ``BROADCAST_TEXTS`` of other texts nothing is shuffled."""
    key = "lost" + "_" * max(map(len, docs.columns))  # a name that no column has
    lost = stage(_overlaps(docs, benchmark)[1].select(F.col("text_key").alias(key)).distinct(), "lost")
    side = F.broadcast(lost) if lost.count() <= BROADCAST_TEXTS else lost
    return docs.join(side, F.md5(F.col("text").cast("string")) == F.col(key), "left_anti")

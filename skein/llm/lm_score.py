"""Language-model scores: the marginal probability of a text over all its segmentations into subword pieces.

The model is a unigram over the pieces of an existing vocabulary, 256 single bytes and an end: a text (its words, A-Z
lower-cased, each behind a word mark, then the end) has the sum, over all ways to cut it into pieces, of the product of
the pieces' probabilities.  A forward recursion in log space sums them.  No piece used holds a word mark but as its first
character, so every segmentation cuts a text at its words, and the recursion over the text is the sum of the recursions
over its words, each of which is run once for the whole corpus.

The installed vocabularies are merge vocabularies, whose scores are ranks and no probabilities.  The first probabilities
come from the ranks by Zipf's law; ``ROUNDS`` rounds of expectation and maximisation over the words of all training rows
(``PRIOR`` pseudo-counts of the first probabilities added) turn them into the corpus's.  Pieces that no text can hold
here (with A-Z, or runs of word marks, which are white space) are left out.

How it is distributed: blocks of documents give each distinct word with its count of training rows once; the counts are
added up by word, and every distinct word is scored once.  Each block's distinct words are joined with their scores and
brought to its documents.  A word's row is as wide as the word, so all exchanges grow with the distinct words of blocks.
What goes to the driver is a number for each piece, and the totals.

Defined results: null text is empty and has only its end; a corpus with no training row scores by the first probabilities;
rows that share a doc_id are scored each; an empty table gives an empty result; a null ``held_out`` counts as false;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import column_bytes, mix, powers, prefix_hash, slices, words
from .staging import stage

BLOCK_BYTES = 8 << 20
ROUNDS, PRIOR = 1, 1000.0
#: First probabilities: the rank of the most frequent piece in Zipf's law, the share of all bytes, and of the end.
ZIPF, BYTE_MASS, END_MASS = 60.0, 1e-3, 1e-2
#: Bytes of words, with their marks, that are scored at once; a longer word is on its own.
CHUNK_BYTES = 1 << 16
_MARK = "▁".encode()
_END = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])
_WORDS = "_block int, hash long, seen long, word binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Vocabulary:
    """Sorted hashes of pieces with their numbers, lengths in bytes, and a filter; after the pieces come bytes and the end."""

    keys: np.ndarray
    number: np.ndarray
    lengths: list[int]
    filter: np.ndarray
    first: np.ndarray  # natural log probabilities before any training
    pieces: list[bytes]


def _spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).encode()
            if _MARK not in piece[1:] and not any(65 <= b <= 90 for b in piece):
                found[piece] = max(found.get(piece, 0.0), 1 / (ZIPF - model.get_score(i)))
    share = np.fromiter(found.values(), float)
    share *= (1 - BYTE_MASS - END_MASS) / share.sum()
    flat, size = np.frombuffer(b"".join(found), np.uint8), np.fromiter(map(len, found), np.int64)
    end = np.cumsum(size)
    h = _spans(prefix_hash(flat), end - size, end)
    order = np.argsort(h)
    some = np.zeros(1 << 20, bool)
    some[h >> np.uint64(44)] = True
    first = np.log(np.concatenate((share, np.full(256, BYTE_MASS / 256), [END_MASS])))
    return Vocabulary(h[order], order, sorted(set(size.tolist())), some, first, list(found))


@dataclass
class Lattice:
    """Arcs of words (concatenated bytes): their pieces, first and end nodes; a word of n bytes has n + 1 nodes."""

    piece: np.ndarray
    first: np.ndarray
    end: np.ndarray
    cuts: np.ndarray  # arcs of one distance from the word's start follow each other
    begin: np.ndarray  # first and last node of each word
    last: np.ndarray

    @staticmethod
    def of(data: np.ndarray, size: np.ndarray, voc: Vocabulary) -> Lattice:
        n = len(data)
        word = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        prefix = prefix_hash(data)
        room = np.repeat(start + size, size) - np.arange(n)
        at, ids, long = [np.arange(n)], [len(voc.keys) + data.astype(np.int64)], [np.ones(n, np.int64)]
        for k in voc.lengths:
            s = np.flatnonzero(room >= k)
            h = _spans(prefix, s, s + k)
            maybe = np.flatnonzero(voc.filter[h >> np.uint64(44)])
            place = np.minimum(np.searchsorted(voc.keys, h[maybe]), len(voc.keys) - 1)
            hit = voc.keys[place] == h[maybe]
            at.append(s[maybe[hit]])
            ids.append(voc.number[place[hit]])
            long.append(np.full(int(hit.sum()), k))
        at, ids, long = np.concatenate(at), np.concatenate(ids), np.concatenate(long)
        first = at + word[at]
        end = first + long
        far = at - start[word[at]] + long
        order = np.lexsort((end, far))
        cuts = np.searchsorted(far[order], np.arange(1, int(size.max(initial=0)) + 2))
        return Lattice(ids[order], first[order], end[order], cuts, start + np.arange(len(size)), start + size + np.arange(len(size)))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Natural log probability of reaching each node, summed over all ways to it."""
        alpha = np.zeros(int(self.last[-1]) + 1 if len(self.last) else 0)
        for lo, hi in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            end = self.end[lo:hi]
            lead = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
            alpha[end[lead]] = _log_sums(alpha[self.first[lo:hi]] + logp[self.piece[lo:hi]], lead)
        return alpha

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, where words count ``weight`` times."""
        alpha, beta = self.forward(logp), np.zeros(int(self.last[-1]) + 1)
        away = np.repeat(self.last, self.last - self.begin + 1) - np.arange(len(beta))  # from the word's end
        back = np.lexsort((self.first, away[self.first]))
        first = self.first[back]
        for lo, hi in _runs(away[first]):
            own = back[lo:hi]
            lead = np.flatnonzero(np.concatenate(([True], first[lo + 1 : hi] != first[lo : hi - 1])))
            beta[first[lo:hi][lead]] = _log_sums(beta[self.end[own]] + logp[self.piece[own]], lead)
        total = np.repeat(alpha[self.last] - np.log(weight), self.last - self.begin + 1)
        return np.bincount(self.piece, np.exp(alpha[self.first] + logp[self.piece] + beta[self.end] - total[self.first]), len(logp))


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return zip(cut[:-1], cut[1:], strict=True)


def _log_sums(x: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Logs of the sums of exponentials over runs that begin at ``lead``."""
    top = np.maximum.reduceat(x, lead)
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(lead, len(x))))), lead))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, row numbers, bytes with marks, sizes) for chunks of words of like size; the empty word of the end is left out."""
    for batch in batches:
        data, off = column_bytes(batch.column(batch.schema.get_field_index("word")).cast(pa.large_binary()).view(pa.large_string()))
        size = np.diff(off)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        total = np.cumsum(size[order] + len(_MARK))
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
            own = order[lo:hi]
            n = size[own]
            first = np.cumsum(n + len(_MARK)) - n
            text = np.zeros(int((n + len(_MARK)).sum()), np.uint8)
            for j, m in enumerate(_MARK):
                text[first - len(_MARK) + j] = m
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            text[np.repeat(first, n) + inner] = data[np.repeat(off[own], n) + inner]
            yield batch, own, text, n + len(_MARK)
            lo = hi


def _expect(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, total = vocabulary(path), np.zeros(len(logp))
        for batch, own, text, size in _marked(batches):
            total += Lattice.of(text, size, voc).expected(logp, batch.column(1).to_numpy()[own].astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])

    return run


def fit(counts: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log probabilities of pieces, bytes and the end, from the training counts of all words (hash, count, word)."""
    first = vocabulary(path).first
    logp = first
    for _ in range(rounds):
        rows = counts.filter("count > 0").select("word", "count").mapInArrow(_expect(path, logp), "piece int, uses double")
        uses = PRIOR * np.exp(first)
        for r in rows.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"]] += r["uses"]
        uses[-1] += ends
        logp = np.log(uses / uses.sum())
    return logp


def _marginal(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            out = np.full(batch.num_rows, logp[-1])  # the end, unless it is a word
            for _, own, text, size in _marked([batch]):
                lattice = Lattice.of(text, size, voc)
                out[own] = lattice.forward(logp)[lattice.last]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(out / math.log(10))], ["hash", "count", "log10"])

    return run


def _block_words(table: pa.Table) -> pa.Table:
    """The distinct words of a block with their counts in training rows, and the end."""
    data, off = column_bytes(table.column("text"))
    train = ~pc.fill_null(table.column("held_out"), False).to_numpy().astype(bool)
    hashes, seen, start, size = [], [], [], []
    for lo, hi, d, o in slices(data, off):
        s, e, h, woff = words(d, o)
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        hashes.append(uniq)
        seen.append(np.bincount(back[np.repeat(train[lo:hi], np.diff(woff))], minlength=len(uniq)))
        start.append(s[first] + off[lo])
        size.append((e - s)[first])
    h, seen, start, size = (np.concatenate([np.zeros(0, k), *x]) for k, x in ((np.uint64, hashes), (np.int64, seen), (np.int64, start), (np.int64, size)))
    uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
    total = np.zeros(len(uniq), np.int64)
    np.add.at(total, back, seen)
    start, size = start[first], size[first]
    cut = np.concatenate(([0], np.cumsum(size)))
    flat = _LOWER[data[np.repeat(start - cut[:-1], size) + np.arange(cut[-1])]]
    word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size) + 1, [None, pa.py_buffer(np.append(cut, cut[-1])), pa.py_buffer(flat.tobytes())])
    number = table.column("_block")[0].as_py()
    cols = [pa.array(np.full(len(size) + 1, number, np.int32)), pa.array(np.append(uniq.view(np.int64), _END)), pa.array(np.append(total, int(train.sum()))), word.cast(pa.binary())]
    return pa.Table.from_arrays(cols, [f.split()[0] for f in _WORDS.split(", ")])


def _score(n: int, v: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        data, off = column_bytes(texts.column("text"))
        key = answers.column("hash").to_numpy()
        order = np.argsort(key)
        key, count, log10 = key[order], answers.column("count").to_numpy()[order], answers.column("log10").to_numpy()[order]
        base = np.log10(count + 1.0) - math.log10(n + v + 1)
        known = (count > 0).astype(np.int64)
        end = int(np.searchsorted(key, _END)) if len(key) else 0
        out: list[list[np.ndarray]] = [[], [], [], []]
        for _, _, d, o in slices(data, off):
            _, _, h, woff = words(d, o)
            at = np.searchsorted(key, h.view(np.int64))
            for k, x in enumerate((np.ones(len(key), np.int64), known, base, log10)):
                cum = np.concatenate((np.zeros(1, x.dtype), np.cumsum(x[at])))
                out[k].append(cum[woff[1:]] - cum[woff[:-1]] + x[end])
        tokens, n_known, bases, scores = (np.concatenate(x) if x else np.zeros(0) for x in out)
        cols = [texts.column("doc_id"), texts.column("held_out"), pa.array(tokens), pa.array(n_known), pa.array(np.full(len(texts), n, np.int64)), pa.array(bases), pa.array(scores)]
        return pa.Table.from_arrays(cols, [f.split()[0] for f in _OUT.split(", ")])

    return run


def score(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Token counts, the add-one base score and the model's log10 probability of every row of (doc_id, text, held_out)."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    cols = [F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("_block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    by_block = docs.select(*cols, F.coalesce("held_out", F.lit(False)).alias("held_out")).groupBy("_block")
    found = stage(by_block.applyInArrow(_block_words, _WORDS), "words")
    # The word is part of the key, so that all of an aggregate's values have a fixed width.
    counts = stage(found.groupBy("hash", "word").agg(F.sum("seen").alias("count")).select("word", "count", "hash"), "counts")
    n, v, ends = counts.agg(F.sum("count"), F.count_if(F.col("count") > 0), F.sum(F.when(F.col("hash") == _END, F.col("count")))).first()
    logp = fit(counts, path, ends or 0, rounds)
    scored = counts.mapInArrow(_marginal(path, logp), "hash long, count long, log10 double")
    answers = found.select("_block", "hash").join(scored, "hash").select("_block", "hash", "count", "log10")
    return by_block.cogroup(answers.groupBy("_block")).applyInArrow(_score(n or 0, v or 0), _OUT)

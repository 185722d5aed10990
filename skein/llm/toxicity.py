"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's chance is a logistic function of its words and word beginnings; a document is toxic unless none of its
sentences is (noisy-or).  The weights are fitted to document labels through the noisy-or, on at most ``SAMPLE`` labelled
documents of each label, chosen by a hash of doc_id, of which each stands for its share of all labelled rows, so that the
scores keep the corpus's base rate.  Features of fewer than ``MIN_DOCS`` documents, or without a clear lean to one label,
have weight 0.  The fitted sentence scores then locate the offending sentences.

Defined results: null or empty text is one empty sentence and has the base chance; conflicting labels of a document
count each; with no labels every score is 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .bytetext import mix, prefix_hash, span_hash, text_slices

SAMPLE, MIN_DOCS, STEPS, THRESHOLD, PENALTY = 1200, 5, 300, 0.3, 2e-4
#: Standard deviations that make a feature worth a weight, and the intercept that the fit starts from.
SURPRISE, START = 5.0, -8.0
PREFIXES = (4, 5, 6, 7, 8)
_OUT = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, offending array<struct<start:int,length:int,score:double>>"
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all sentences (one at least for each row), each behind a run of stops, and offsets of the rows."""
    first = np.zeros(len(data) + 1, bool)
    first[1:] = _STOP[data]
    first[: len(data)] &= ~_STOP[data]
    first[off[-1] :] = False
    inner = np.flatnonzero(first)
    inner = inner[~np.isin(inner, off)]
    start = np.sort(np.concatenate((off[:-1], inner)), kind="stable")
    # Empty rows share their first byte with the next row; counting keeps one sentence for each row.
    count = 1 + np.searchsorted(inner, off[1:]) - np.searchsorted(inner, off[:-1])
    return start, np.concatenate(([0], np.cumsum(count)))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, their sentences, first bytes of sentences, and sentence offsets of the rows."""
    start, soff = sentences(data, off)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), start, soff
    ink = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = np.flatnonzero(ink & (edge[:n] | np.concatenate(([True], ~ink[:-1]))))
    end = np.flatnonzero(ink & (edge[1:] | np.concatenate((~ink[1:], [True])))) + 1
    prefix = prefix_hash(_LOWER[data])
    owner = np.searchsorted(start, begin, "right") - 1
    hashes, owners = [span_hash(prefix, begin, end)], [owner]
    for k in PREFIXES:
        long = end - begin > k
        hashes.append(mix(span_hash(prefix, begin[long], begin[long] + k) + np.uint64(k)))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners), start, soff


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, data, off in text_slices(batches):
        h, s, _, soff = features(data, off)
        order = np.argsort(s, kind="stable")
        h, s = h[order], s[order]
        cut = np.searchsorted(s, soff)
        ids, toxic = (batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in ("doc_id", "toxic"))
        bags = [h[cut[r] : cut[r + 1]].tobytes() for r in range(hi - lo)]
        where = [(s[cut[r] : cut[r + 1]] - soff[r]).astype(np.int32).tobytes() for r in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([ids, toxic, pa.array(bags, pa.binary()), pa.array(where, pa.binary()), pa.array(np.diff(soff).astype(np.int32))], ["doc_id", "toxic", "h", "s", "n"])


class Model:
    """Sorted feature hashes with weights, and the intercept of a sentence."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.keys, self.weights, self.intercept = keys, weights, intercept

    def logits(self, h: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        if not len(self.keys) or not len(h):
            return np.full(n, self.intercept)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        pair = np.unique(s[hit] * len(self.keys) + at[hit])  # a feature counts once in a sentence
        return self.intercept + np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], n)


def fit(h: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood of document labels through the noisy-or, with Adam steps and a smoothed L1 penalty.

    Only features whose share of toxic documents is ``SURPRISE`` standard deviations off the base rate are fitted, from
    half their log odds on: where several of them occur together, each would else leave the explanation to the others.
    """
    keys, at = np.unique(h, return_inverse=True)
    pair = np.unique(at.astype(np.int64) * len(y) + doc_of[sentence])
    key, doc = pair // len(y), pair % len(y)
    docs, total, toxic = np.bincount(key, minlength=len(keys)), np.bincount(key, weight[doc], len(keys)), np.bincount(key, (weight * y)[doc], len(keys))
    base = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    telling = (docs >= MIN_DOCS) & (np.abs(toxic - total * base) >= SURPRISE * np.sqrt(total * base * (1 - base)))
    odds = np.log((toxic + base / 2) / (np.maximum(total - toxic, 0) + (1 - base) / 2)) - np.log(base / (1 - base))
    number = np.cumsum(telling) - 1
    use = telling[at]
    keys, n, docs = keys[telling], len(doc_of), len(y)
    pair = np.unique(sentence[use] * max(1, len(keys)) + number[at[use]])  # a feature counts once in a sentence
    sentence, at = pair // max(1, len(keys)), pair % max(1, len(keys))
    theta = np.append(odds[telling] / 2, START)
    m, v, share = np.zeros_like(theta), np.zeros_like(theta), weight / weight.sum()
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, theta[at], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = -np.bincount(doc_of, np.logaddexp(0, z), docs)  # log chance that no sentence is toxic
        ratio = np.exp(none) / np.maximum(-np.expm1(none), 1e-9)
        dz = (np.where(y > 0, -ratio, 1.0) * share)[doc_of] * p
        g = np.append(np.bincount(at, dz[sentence], len(keys)), dz.sum())
        g[:-1] += PENALTY * np.tanh(10 * theta[:-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 if t <= 0.8 * steps else 0.01
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(keys, theta[:-1], float(theta[-1]))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, toxic); a label weighs as much as in all its rows."""
    rows = labelled.filter("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.col("text").cast("string").alias("text"))
    ids = sampling.sample(rows, "toxic", sample)
    # The first join needs the documents' side only, so that it comes before their texts are shuffled to the labels.
    some = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    got = some.join(F.broadcast(ids), ["doc_id", "toxic"], "left_semi").select("doc_id", "toxic", "text").mapInArrow(_bags, "doc_id long, toxic int, h binary, s binary, n int").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "toxic"])
    base = np.concatenate(([0], np.cumsum(got.n)))
    h = np.concatenate([np.frombuffer(b, np.uint64) for b in got.h])
    s = np.concatenate([np.frombuffer(b, np.int32).astype(np.int64) + k for b, k in zip(got.s, base, strict=False)])
    doc_of, label = np.repeat(np.arange(len(got)), got.n), got.toxic.to_numpy()
    del got
    every = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.zeros(len(label))
    for value in np.unique(label).tolist():
        own = label == value
        weight[own] = every[value] / own.sum()
    return fit(h, s, doc_of, (label > 0).astype(np.int64), weight)


def score(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending (byte spans) for every row of ``docs``."""
    model = train(labelled, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, off in text_slices(batches):
            n = hi - lo
            h, s, start, soff = features(data, off)
            z = model.logits(h, s, len(start)) if model else np.full(len(start), -40.0)
            none = np.concatenate(([0.0], np.cumsum(np.logaddexp(0, z))))
            total = -np.expm1(-(none[soff[1:]] - none[soff[:-1]])) if model else np.zeros(n)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            stop = np.append(start[1:], len(data))
            bad = np.flatnonzero(p >= THRESHOLD)
            row = np.searchsorted(soff, bad, "right") - 1
            cut = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array((start[bad] - off[row]).astype(np.int32)), pa.array((stop[bad] - start[bad]).astype(np.int32)), pa.array(p[bad])], ["start", "length", "score"])
            cols = [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(total), pa.array((total >= THRESHOLD).astype(np.int32)), pa.array(np.diff(soff).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut), spans)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out").mapInArrow(run, _OUT)

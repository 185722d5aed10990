"""Language identification in two steps: the family first, then one-versus-one linear support vector machines in it.

Features are relative frequencies of hashed runs of one to three lower-cased characters over the whole text.  All
machines are linear in them, so a text's margins are means of per-position weights and need no vectors.  The families'
machines come first, then only those of the chosen family, so a text costs what its family costs.  The machines are fitted on at most ``SAMPLE`` labelled documents with a letter of each language, chosen by a hash of doc_id.

Defined results: null text, and text without a letter, is ``und`` with score 0; with no labelled document everything is
``und``; with one language every text with a letter is of it, with score 1; rows that share a doc_id are scored each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .bytetext import text_slices

SAMPLE = 400
#: Two coins have 0.25; a text with less than this is of no language that was learned.
REJECT = 0.3
BITS = (10, 12, 13)
#: Families of languages by code; another language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("es", "fr", "pt", "it", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "sinitic": ("zh", "yue", "wuu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_OUT = "doc_id long, held_out boolean, lang_pred string, score double"
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x500)], np.uint32)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def positions(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers at each character for each run length (-1 over a row's end), and row offsets in characters."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    low = np.where(cp < len(_LOWER), _LOWER[np.minimum(cp, len(_LOWER) - 1)], cp).astype(np.uint32)
    row_end = np.repeat(lead[1:], np.diff(lead))
    out, acc, base = [], np.zeros(len(low), np.uint32), 0
    for k, bits in enumerate(BITS):
        acc = acc * np.uint32(0x01000193)
        acc[: len(low) - k] += low[k:] + np.uint32(1)
        mixed = acc * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        number = ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int32) + base
        number[np.arange(len(low)) + k >= row_end] = -1
        out.append(number)
        base += 1 << bits
    return out, lead


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature numbers of each text (unsigned 16-bit) and their frequencies (32-bit floats)."""
    for batch, lo, hi, data, off in text_slices(batches):
        found, lead = positions(data, off)
        at, freq = [], []
        for r in range(hi - lo):
            own = np.concatenate([f[lead[r] : lead[r + 1]] for f in found])
            number, count = np.unique(own[own >= 0], return_counts=True)
            at.append(number.astype(np.uint16).tobytes())
            freq.append((count / max(1, lead[r + 1] - lead[r])).astype(np.float32).tobytes())
        lang = batch.column(batch.schema.get_field_index("lang")).slice(lo, hi - lo)
        ids = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo)
        yield pa.RecordBatch.from_arrays([ids, lang, pa.array(at, pa.binary()), pa.array(freq, pa.binary())], ["doc_id", "lang", "at", "freq"])


@dataclass
class Rows:
    """Sparse rows: row r has the features at[cut[r]:cut[r+1]] with the values of the same places of x."""

    at: np.ndarray
    x: np.ndarray
    cut: np.ndarray

    def margins(self, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """w . row + intercept (the last weight)."""
        return np.array([self.x[a:b] @ w[self.at[a:b]] for a, b in zip(self.cut[rows], self.cut[rows + 1], strict=True)]) + w[-1]


def fit_svm(data: Rows, rows: np.ndarray, y: np.ndarray, width: int, cost: float = 1.0, epochs: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM by dual coordinate descent, both classes of equal weight; the last weight is the intercept."""
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    slack = share / cost  # 1 / (2 cost), where a class of half the rows counts once
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    own = [(data.at[a:b], data.x[a:b]) for a, b in zip(data.cut[rows], data.cut[rows + 1], strict=True)]
    norm = np.array([x @ x for _, x in own]) + 1 + slack
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = own[i]
            g = y[i] * (x @ w[at] + w[-1]) - 1 + alpha[i] * slack[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class Level:
    """The machines of one pool of classes: per-feature weights (a last row of zeros for no feature), and their sides."""

    classes: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    slopes: np.ndarray
    sides: list[tuple[int, int]]

    def decide(self, found: list[np.ndarray], lead: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``rows`` (with a character at least) the class of most won machines, and its least chance."""
        n, kinds = len(rows), len(self.classes)
        if kinds == 1 or not n:
            return np.zeros(n, np.int64), np.ones(n)
        size = np.diff(lead)[rows]
        first = np.cumsum(size) - size
        at = np.repeat(lead[rows] - first, size) + np.arange(int(size.sum()))
        total = sum(np.add.reduceat(self.weights[f[at]], first, axis=0, dtype=np.float64) for f in found)
        margin = total / size[:, None] + self.intercepts
        chance = 1 / (1 + np.exp(-np.clip(self.slopes * margin, -30, 30)))
        won, sure, least = np.zeros((n, kinds)), np.zeros((n, kinds)), np.ones((n, kinds))
        for k, (a, b) in enumerate(self.sides):
            for c, p in ((a, chance[:, k]), (b, 1 - chance[:, k])):
                won[:, c] += p > 0.5
                sure[:, c] += p
                least[:, c] = np.minimum(least[:, c], p)
        best = kinds - 1 - np.argmax((won + sure / (2 * kinds))[:, ::-1], axis=1)
        return best, least[np.arange(n), best]


@dataclass
class Model:
    """The families' machines, and each family's own."""

    families: Level
    languages: list[Level]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of the labelled rows of ``docs`` (doc_id, text, lang)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = known.join(F.broadcast(sampling.sample(known, "lang", sample)), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    got = rows.mapInArrow(_vectors, "doc_id long, lang string, at binary, freq binary").toPandas().sort_values(["lang", "doc_id"])
    if not len(got):
        return None
    lang, width = got.lang.to_numpy(), sum(1 << b for b in BITS)
    data = Rows(np.frombuffer(b"".join(got["at"]), np.uint16), np.frombuffer(b"".join(got["freq"]), np.float32).astype(np.float64), np.concatenate(([0], np.cumsum(got["at"].map(len)) // 2)))
    del got
    mean, square = (np.bincount(data.at, v, width) / len(lang) for v in (data.x, data.x**2))
    scale = 1 / (np.sqrt(np.maximum(square - mean**2, 0)) + 1e-4) / np.sqrt(width)
    data.x *= scale[data.at]
    families: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        families.setdefault(family_of(name), []).append(name)
    family = np.array([family_of(v) for v in lang])

    def level(label: np.ndarray, classes: list[str]) -> Level:
        pairs = list(combinations(range(len(classes)), 2))
        weights, intercepts, slopes = np.zeros((width + 1, len(pairs)), np.float32), np.zeros(len(pairs)), np.zeros(len(pairs))
        for k, (a, b) in enumerate(pairs):
            own = np.flatnonzero((label == classes[a]) | (label == classes[b]))
            y = np.where(label[own] == classes[a], 1.0, -1.0)
            w = fit_svm(data, own, y, width)
            weights[:-1, k], intercepts[k] = w[:-1] * scale, w[-1]
            slopes[k] = 3 / max(float(np.median(y * data.margins(w, own))), 1e-6)  # a typical training margin is 95 % sure
        return Level(classes, weights, intercepts, slopes, pairs)

    return Model(level(family, list(families)), [level(lang, langs) for langs in families.values()])


def predict(model: Model | None, data: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every row of a slice; a row without a letter is ``und``.  Only the chosen family's machines run."""
    lang, score = np.full(len(off) - 1, "und", object), np.zeros(len(off) - 1)
    rows = np.flatnonzero(letters)
    if model and len(rows):
        found, lead = positions(data, off)
        family, chance = model.families.decide(found, lead, rows)
        for k, level in enumerate(model.languages):
            own = rows[family == k]
            best, least = level.decide(found, lead, own)
            lang[own], score[own] = np.array(level.classes, object)[best], chance[family == k] * least
    return lang, score


def identify(docs: DataFrame, learn: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, held_out); ``learn`` has lang too."""
    model = train(learn, sample)
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out", letter.alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, off in text_slices(batches):
            n = hi - lo
            lang, score = predict(model, data, off, batch.column(3).slice(lo, n).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, _OUT)


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and others) for which a language is found; nothing is shuffled.

    A text goes if it has no letter, or if its score is under ``REJECT``: the machines of both steps together are hardly
    surer than two coins.  Where no row is labelled there is no model that could reject, and every row with a letter stays.
    """
    model = train(docs, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, off in text_slices(batches):
            part = batch.slice(lo, hi - lo)
            letters = pc.fill_null(pc.match_substring_regex(part.column(at).cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = predict(model, data, off, letters)
            yield part.filter(pa.array((lang != "und") & (score >= REJECT) if model else letters))

    return docs.mapInArrow(run, docs.schema)

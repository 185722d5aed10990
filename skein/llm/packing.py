"""Best-fit packing by length patterns.

Documents become token ids and one end id; a longer document is cut into full pieces behind a first piece that takes the
rest.  The histogram of piece lengths (at most ``seq_len`` counts, whatever the corpus) goes to the driver.  There,
patterns of a few lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left is packed by best fit, decreasing, on the histogram too.
The plan has a bounded number of entries; every piece finds its place from its rank among the pieces of its length.

Defined results: null text is empty and still has its end id; rows that share a doc_id are packed each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import text_slices
from .staging import stage
from .tokens import encoder

SEQ_LEN, END_ID = 2048, 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str | None = None) -> DataFrame:
    """Every document's ids, cut to at most ``seq_len``: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch, lo, hi, data, off in text_slices(batches):
            lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            ids, cut = enc.encode(data.tobytes().decode("utf-8", "replace"), lead[off])
            doc = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo).to_pylist()
            rows = []
            for r, d in enumerate(doc):
                own = np.append(ids[cut[r] : cut[r + 1]], np.uint32(END_ID)).astype("<u4")
                head = (len(own) - 1) % seq_len + 1
                at = 0
                for k, end in enumerate(range(head, len(own) + 1, seq_len)):
                    rows.append((d, k, at, end - at, zlib.crc32(own[at:end].tobytes())))
                    at = end
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def enumerate_patterns(counts: np.ndarray, seq_len: int) -> list[tuple[int, ...]]:
    """Patterns of two to five lengths that exist and fill a sequence up to one part in 256."""
    have = np.flatnonzero(counts)

    def most(room: int) -> int:
        k = int(np.searchsorted(have, room, "right"))
        return int(have[k - 1]) if k else 0

    found: dict[tuple[int, ...], None] = {}
    for a in have[::-1].tolist():
        for parts in range(1, 5):
            for share in (0.35, 0.5, 0.7) if parts > 1 else (1,):
                pattern, room = [a], seq_len - a
                for left in range(parts, 0, -1):
                    b = most(int(room * share) if left > 1 else room)
                    if b:
                        pattern.append(b)
                        room -= b
                if room * 256 <= seq_len:
                    found[tuple(sorted(pattern, reverse=True))] = None
    return list(found)


def fit_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern repeats to the histogram, by accelerated projected gradients."""
    rows = np.concatenate([np.full(len(p), i) for i, p in enumerate(patterns)])
    cols = np.concatenate([np.array(p) for p in patterns])
    scale = 1 / np.sqrt(np.maximum(counts, 1))  # relative errors: rare lengths count as well

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(cols, x[rows], len(counts)) * scale

    def back(y: np.ndarray) -> np.ndarray:
        return np.bincount(rows, (y * scale)[cols], len(patterns))

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(np.linalg.norm(back(forward(v))), 1e-12)
    target, x, y, t = counts * scale, np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan_packing(counts: np.ndarray, seq_len: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: copies}) whose lengths add up to the histogram ``counts`` (index: length)."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[int, dict[int, int]]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        if times > 0:
            plan.append((times, pattern))
            for length, n in pattern.items():
                left[length] -= n * times

    if left[seq_len]:
        take({seq_len: 1}, int(left[seq_len]))
    patterns = enumerate_patterns(left, seq_len)
    if patterns:
        repeats = fit_repeats(patterns, left.astype(float))
        for i in np.argsort(-repeats, kind="stable"):
            bag: dict[int, int] = {}
            for length in patterns[i]:
                bag[length] = bag.get(length, 0) + 1
            take(bag, min(int(repeats[i]), *(int(left[k]) // n for k, n in bag.items())))
    # Residuals: best fit, decreasing; groups of equal sequences are kept by the room they have.
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            room = min((r for r in rooms if r >= length), default=seq_len)
            times, bag = rooms[room].pop() if room in rooms else (n, {})
            if room in rooms and not rooms[room]:
                del rooms[room]
            copies = min(room // length, n)
            used = min(times, n // copies)
            if times > used and bag:
                rooms.setdefault(room, []).append((times - used, bag))
            n -= used * copies
            rooms.setdefault(room - length * copies, []).append((used, bag | {length: copies}))
    plan += [group for groups in rooms.values() for group in groups]
    return plan


def _places(plan: list[tuple[int, dict[int, int]]], counts: np.ndarray) -> np.ndarray:
    """Rows (first global rank, first sequence, copies, offset, length) by rank; ranks run through lengths in order."""
    base = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64)
    rows, sequence = [], 0
    for times, bag in plan:
        offset = 0
        for length, n in bag.items():
            rows.append((base[length], sequence, n, offset, length))
            base[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    cut = stage(pieces(docs, seq_len, tokenizer), "pieces")
    hist = cut.groupBy("length").count().collect()  # at most seq_len rows
    counts = np.zeros(seq_len + 1, np.int64)
    for r in hist:
        counts[r["length"]] = r["count"]
    places = _places(plan_packing(counts, seq_len), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64)
    # A length may hold any share of the pieces, so ranks are counted within (length, salt) and shifted.
    salts = max(1, math.isqrt(int(counts.sum())))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").count()
    shift = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("shift"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))).join(shift, ["length", "salt"])
    ranked = ranked.select(*[c.split()[0] for c in _PIECES.split(", ")], (F.col("rank") + F.col("shift") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(5).to_numpy() + first[b.column(3).to_numpy()]
            p = places[np.searchsorted(places[:, 0], rank, "right") - 1] if len(rank) else np.zeros((0, 5), np.int64)
            d = rank - p[:, 0]
            copies = np.maximum(p[:, 2], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p[:, 1] + d // copies), pa.array(p[:, 3] + d % copies * p[:, 4])], [c.split()[0] for c in _PLACED.split(", ")])

    return ranked.mapInArrow(place, _PLACED)

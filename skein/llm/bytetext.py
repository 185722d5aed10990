"""Vectorised kernels over batches of UTF-8 text, for use inside Arrow tasks.

A batch is one ``uint8`` array plus row offsets.  Slices are bounded by bytes, so memory does not depend on the number
of rows in an Arrow batch; a single longer text is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and inverse powers, as long as ``n`` at least."""
    if len(_powers[0]) < n:
        for k, m in enumerate((_MULT, _INV)):
            a = np.full(max(n, SLICE_BYTES + (1 << 16)), m, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(data: np.ndarray, off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one longer row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash, one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of data[start:end]."""
    inv = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, 64-bit hashes (A-Z lower-cased first), and word offsets of the rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), np.zeros(len(off), np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off[:-1]] = edge[off[1:]] = True
    start = np.flatnonzero(ink & (edge[:-1] | np.concatenate(([True], ~ink[:-1]))))
    end = np.flatnonzero(ink & (edge[1:] | np.concatenate((~ink[1:], [True])))) + 1
    h = span_hash(prefix_hash(_LOWER[data] if lower else data), start, end)
    return start, end, h, np.searchsorted(start, off)


def shingles(h: np.ndarray, woff: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within a row, and row offsets; a row with fewer words has one run of all."""
    n = len(h)
    c = np.uint64(_MULT)
    counts = np.diff(woff)
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_off = np.concatenate(([0], np.cumsum(out_counts)))
    if n == 0:
        return np.zeros(0, np.uint64), out_off
    acc = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        acc = acc * c + h[j : n - size + 1 + j]
    full = counts >= size
    out = np.zeros(out_off[-1], np.uint64)
    place = np.repeat(out_off[:-1][full] - woff[:-1][full], out_counts[full])
    rank = np.flatnonzero(np.repeat(full, out_counts))
    out[rank] = mix(acc[rank - place]) if len(rank) else acc[:0]
    for r in np.flatnonzero((counts > 0) & ~full):
        v = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in h[woff[r] : woff[r + 1]]:
                v = v * c + x
            out[out_off[r]] = mix(np.array([v + np.uint64(counts[r])]))[0]
    return out, out_off


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES):
    """(record batch, first row, end row, bytes, offsets) over all batches of a task."""
    for batch in batches:
        data, off = column_bytes(batch.column(batch.schema.get_field_index(text)))
        for lo, hi, d, o in slices(data, off, limit):
            yield batch, lo, hi, d, o

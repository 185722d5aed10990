"""Suffix-array dedup over a run-length index: bytes covered by a 50-byte string that a smaller doc_id also starts.

How the index is distributed.  Every 50-byte window has one anchor, the least-hashed 20-byte gram in it, which depends on
the window alone; neighbouring windows with the same anchor form a phrase, so equal windows always lie in phrases of
equal anchors.  As in prefix-free parsing, a phrase that occurs many times enters the dictionary once:

1. blocks of documents tell the anchor's bucket each distinct phrase once (anchor, content hash, least document);
2. a bucket asks the block of the least document for the bytes of each phrase that matters: one that several documents
   have, or whose anchor has other phrases as well;
3. that block sends the bytes, once for all blocks that have the phrase;
4. the bucket builds run-length indexes over its dictionary, in slices of whole anchors, streams the matching statistics of
   all phrases, and answers each block with the least document for each window;
5. blocks mark the windows that a smaller document has.  Nothing is removed but by an answer of an index.

A hot passage is one phrase for each block, never one row for each document, and no step holds more than a block or a
bucket.  Messages carry 32 bits of the anchor besides those of its bucket (anchors that meet only share a slice) and 48
bits of the content hash; documents are numbers as narrow as a message allows.  Only filled buckets get messages.

Defined results: null text is empty and keeps nothing to remove; texts under 50 bytes are kept; rows with equal doc_id
do not remove from each other; a null doc_id is larger than any other; further columns stay untouched.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bytetext import column_bytes, mix, powers, prefix_hash, slices, span_hash
from .rlindex import RunLengthIndex

WINDOW, ANCHOR = 50, 20
BLOCK_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
_LAST = np.iinfo(np.int64).max
_PHRASES = "_bucket int, _block int, base long, mins binary, keys binary, lo binary, multi binary"
_ASK = "_block int, bucket int, idx binary"
_DICT = "_bucket int, _block int, more binary, data binary"
_REPLY = "_block int, bucket int, base long, idx binary, whole binary, vals binary"


def phrases(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows, last windows, anchor hashes and content hashes of the phrases of all rows."""
    n, grams = len(data), WINDOW - ANCHOR + 1
    if n < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    prefix = prefix_hash(data)
    gram = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * powers(n + 1)[1][: n - ANCHOR + 1])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if grams > span:
        low = np.minimum(low[: len(low) - (grams - span)], low[grams - span :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = n - WINDOW + 1
    cross = np.bincount(np.maximum(off[:-1], off[1:] - (WINDOW - 1)), minlength=n + 1) - np.bincount(off[1:], minlength=n + 1)
    inside = np.cumsum(cross)[:windows] == 0
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    first = np.flatnonzero(inside & (new | ~before))
    last = np.flatnonzero(inside & (np.concatenate((new[1:], [True])) | ~after))
    return first, last, gram[anchor[first]], span_hash(prefix, first, last + WINDOW)


class _Block:
    """All phrases of a block, and its distinct ones by bucket, in each by their least document."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        self.data, self.off = column_bytes(table.column("text"))
        self.ids = pc.fill_null(table.column("doc_id"), _LAST).to_numpy()
        parts = []
        for lo, _, d, o in slices(self.data, self.off):
            first, last, anchor, content = phrases(d, o)
            parts.append(((first + self.off[lo]).astype(np.uint32), (last - first).astype(np.uint8), anchor, content))
        cat = lambda k, kind: np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)])
        self.first, self.more, anchor, content = cat(0, np.uint32), cat(1, np.uint8), cat(2, np.uint64), cat(3, np.uint64)
        parts.clear()
        self.row = (np.searchsorted(self.off, self.first, "right") - 1).astype(np.uint32)
        key = mix(anchor + mix(content))
        del content
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]]))[: len(key)])
        sample = order[at]
        docs = self.ids[self.row[order]]
        lo = np.minimum.reduceat(docs, at) if len(at) else docs
        hi = np.maximum.reduceat(docs, at) if len(at) else docs
        anchor = anchor[sample]
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        sort = np.lexsort((key[sample], lo, bucket))
        place = np.empty(len(sort), np.uint32)
        place[sort] = np.arange(len(sort), dtype=np.uint32)
        self.entry = np.zeros(len(key), np.uint32)
        self.entry[order] = np.repeat(place, np.diff(np.append(at, len(key))))
        self.sample, self.lo, self.hi, self.key = sample[sort], lo[sort], hi[sort], key[sample[sort]]
        self.anchor = (anchor[sort] // np.uint64(buckets)).astype(np.uint32)
        found, cut = np.unique(bucket[sort], return_index=True)
        #: First and end entry of each filled bucket.
        self.cuts = dict(zip(found.tolist(), zip(cut.tolist(), [*cut[1:].tolist(), len(sort)], strict=True), strict=True))


def _pack48(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, "<u4", n).astype(np.uint64) | (np.frombuffer(b, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def _pack_ids(x: np.ndarray) -> tuple[int, bytes]:
    """The least number, and the others above it in as few bytes each as the largest needs."""
    base = int(x.min(initial=_LAST))
    above = (x - base).astype(np.uint64)
    top = int(above.max(initial=0))
    return base, above.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if top < 1 << (8 * n))).tobytes()


def _unpack_ids(base: int, b: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(b, f"<u{len(b) // n}").astype(np.int64) if n else np.zeros(0, np.int64)) + base


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    cum = np.cumsum(size) - size
    return np.repeat(start - cum, size) + np.arange(int(size.sum()))


def _send_phrases(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("_block")[0].as_py()
        b = _Block(table, buckets)
        rows = []
        for k, (lo, hi) in b.cuts.items():
            s = slice(lo, hi)
            rows.append((k, number, *_splice(_pack_ids(b.lo[s]), b.anchor[s].astype("<u4").tobytes(), _pack48(b.key[s] & np.uint64((1 << 48) - 1))), np.packbits(b.lo[s] < b.hi[s]).tobytes()))
        return _table(_PHRASES, rows)

    return run


def _splice(ids: tuple[int, bytes], *between: bytes) -> tuple:
    return (ids[0], *between, ids[1])


class _Bucket:
    """What blocks told of a bucket's phrases, and the dictionary of those that matter, in order of anchors.

    It depends on the messages alone, not on their order, so that every step finds the same numbers and owners.
    """

    def __init__(self, table: pa.Table) -> None:
        rows = sorted(table.select(["_block", "base", "mins", "keys", "lo", "multi"]).to_pylist(), key=lambda r: r["_block"])
        sizes = [len(r["mins"]) // 4 for r in rows]
        self.number = table.column("_bucket")[0].as_py()
        self.blocks = [r["_block"] for r in rows]
        self.cut = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        anchor = np.concatenate([np.frombuffer(r["mins"], "<u4") for r in rows])
        key = np.concatenate([_unpack48(r["keys"]) for r in rows])
        self.lo = np.concatenate([_unpack_ids(r["base"], r["lo"], n) for r, n in zip(rows, sizes, strict=True)])
        self.multi = np.concatenate([np.unpackbits(np.frombuffer(r["multi"], np.uint8), count=n).astype(bool) for r, n in zip(rows, sizes, strict=True)])
        del rows
        order = np.lexsort((key, anchor))
        a, k = anchor[order], key[order]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new_k = new_a | np.concatenate(([True], k[1:] != k[:-1]))
        at = np.flatnonzero(new_k)
        group = np.cumsum(new_k) - 1
        least = np.minimum.reduceat(self.lo[order], at)
        many = np.logical_or.reduceat(self.multi[order], at) | (np.diff(np.append(at, len(order))) > 1)
        kinds = np.diff(np.append(np.flatnonzero(new_a[at]), len(at)))
        matters = many | np.repeat(kinds > 1, kinds)
        #: Dictionary number of each entry, or -1; least document and anchor of each number.
        self.phrase = np.full(len(order), -1)
        self.phrase[order] = np.where(matters, np.cumsum(matters) - 1, -1)[group]
        self.least, self.anchor = least[matters], a[at][matters]
        # The first entry that has a phrase's least document owns it.
        holds = np.flatnonzero(matters[group] & (self.lo[order] == least[group]))
        own = group[holds]
        self.owned = np.sort(order[holds[np.concatenate(([True], own[1:] != own[:-1]))[: len(own)]]])

    def of_block(self, i: int, entries: np.ndarray) -> np.ndarray:
        """Those of the sorted ``entries`` that are of the i-th block, counted from its first."""
        lo, hi = np.searchsorted(entries, self.cut[i : i + 2])
        return entries[lo:hi] - self.cut[i]


def _ask(table: pa.Table) -> pa.Table:
    bucket = _Bucket(table)
    asked = [(block, bucket.of_block(i, bucket.owned)) for i, block in enumerate(bucket.blocks)]
    return _table(_ASK, [(block, bucket.number, idx.astype("<u4").tobytes()) for block, idx in asked if len(idx)])


def _send_bytes(buckets: int):
    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        rows = []
        if len(texts) and len(asks):
            number = texts.column("_block")[0].as_py()
            b = _Block(texts, buckets)
            for r in asks.select(["bucket", "idx"]).to_pylist():
                entry = b.sample[b.cuts[r["bucket"]][0] + np.frombuffer(r["idx"], "<u4").astype(np.int64)]
                more = b.more[entry]
                rows.append((r["bucket"], number, more.tobytes(), b.data[_ragged(b.first[entry].astype(np.int64), more.astype(np.int64) + WINDOW)].tobytes()))
        return _table(_DICT, rows)

    return run


def _answer_windows(told: pa.Table, sent: pa.Table) -> pa.Table:
    """Index the bucket's dictionary and stream it: for each block the least documents of its phrases' windows."""
    if not len(told) or not len(sent):
        return _table(_REPLY, [])
    bucket = _Bucket(told)
    rows = sorted(sent.select(["_block", "more", "data"]).to_pylist(), key=lambda r: r["_block"])
    more = np.concatenate([np.frombuffer(r["more"], np.uint8) for r in rows]).astype(np.int64)
    data = np.frombuffer(b"".join(r.pop("data") for r in rows), np.uint8)
    start = np.cumsum(more + WINDOW) - (more + WINDOW)
    # From the owners' order to that of the dictionary.
    order = np.argsort(bucket.phrase[bucket.owned])
    start, size = start[order], more[order] + WINDOW
    off = np.concatenate(([0], np.cumsum(size - WINDOW + 1)))
    least = np.empty(off[-1], np.int64)
    border = np.flatnonzero(np.concatenate(([True], bucket.anchor[1:] != bucket.anchor[:-1], [True])))
    part = (np.concatenate(([0], np.cumsum(size)))[border]) // SLICE_BYTES
    cuts = np.append(border[:-1][np.concatenate(([True], part[1:-1] != part[:-2]))], border[-1])
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        index = RunLengthIndex(data[_ragged(start[x:y], size[x:y])], size[x:y])
        least[off[x] : off[y]] = index.least(bucket.least[x:y], WINDOW)
    lowest = np.minimum.reduceat(least, off[:-1])
    alike = lowest == np.maximum.reduceat(least, off[:-1])
    told_more = np.flatnonzero((bucket.phrase >= 0) & (bucket.multi | (lowest[bucket.phrase] < bucket.lo)))
    out = []
    for i, block in enumerate(bucket.blocks):
        idx = bucket.of_block(i, told_more)
        if len(idx):
            phrase = bucket.phrase[idx + bucket.cut[i]]
            whole, parts = alike[phrase], phrase[~alike[phrase]]
            vals = np.concatenate((lowest[phrase[whole]], least[_ragged(off[parts], off[parts + 1] - off[parts])]))
            out.append((block, bucket.number, *_splice(_pack_ids(vals), idx.astype("<u4").tobytes(), np.packbits(whole).tobytes())))
    return _table(_REPLY, out)


def _mark(buckets: int, names: list[str], schema: pa.Schema):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(texts):
            return schema.empty_table()
        b = _Block(texts, buckets)
        # Without an answer a phrase is of this document alone.
        least = np.full(len(b.lo), _LAST)
        at, count, flat, used = np.zeros(len(least), np.int64), np.zeros(len(least), np.uint8), [], 0
        for batch in replies.to_batches(64):
            for r in batch.to_pylist():
                idx = np.frombuffer(r["idx"], "<u4").astype(np.int64)
                entry = b.cuts[r["bucket"]][0] + idx
                whole = np.unpackbits(np.frombuffer(r["whole"], np.uint8), count=len(idx)).astype(bool)
                parts = entry[~whole]
                own = b.more[b.sample[parts]].astype(np.int64) + 1
                alike = len(idx) - len(parts)
                vals = _unpack_ids(r["base"], r["vals"], alike + int(own.sum()))
                least[entry[whole]] = vals[:alike]
                count[parts] = own
                at[parts] = used + np.cumsum(own) - own
                flat.append(vals[alike:])
                used += len(flat[-1])
        windows = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        flat.clear()
        texts_left, digests, removed, spans = [], [], [], []
        for lo, hi, data, off in slices(b.data, b.off):
            # The phrases of these rows, which follow each other.
            p, q = (int(x) for x in np.searchsorted(b.row, [lo, hi]))
            entry, first, more, doc = b.entry[p:q], b.first[p:q].astype(np.int64) - b.off[lo], b.more[p:q].astype(np.int64), b.ids[b.row[p:q]]
            whole = least[entry] < doc
            part = np.flatnonzero(~whole & (count[entry] > 0))
            c = count[entry[part]].astype(np.int64)
            smaller = windows[_ragged(at[entry[part]], c)] < np.repeat(doc[part], c)
            one = _ragged(first[part], c)[smaller]
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, np.concatenate((first[whole], one)), 1)
            np.subtract.at(step, np.concatenate((first[whole] + more[whole], one)) + WINDOW, 1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            lead = np.zeros(len(data) + 1, bool)
            lead[off] = True
            rise = np.flatnonzero(gone & (lead[:-1] | np.concatenate(([True], ~gone[:-1]))[: len(data)]))
            spans.append(np.diff(np.searchsorted(rise, off)))
            lost = np.flatnonzero(gone)
            removed.append(np.diff(np.searchsorted(lost, off)))
            for r in range(hi - lo):
                s, e = int(off[r]), int(off[r + 1])
                left = data[s:e].tobytes() if not removed[-1][r] else data[s:e][~gone[s:e]].tobytes()
                digests.append(hashlib.sha256(left).hexdigest())
                texts_left.append(left.decode("utf-8", "ignore"))
        cols = {"doc_id": texts.column("doc_id"), "text": pa.array(texts_left, pa.string()), "n_bytes": pa.array(np.diff(b.off)), "n_removed": pa.array(np.concatenate(removed)), "n_spans": pa.array(np.concatenate(spans)), "kept_sha256": pa.array(digests, pa.string())}
        if "_row" in names:
            cols["_row"] = texts.column("_row").cast(schema.field("_row").type)  # the struct comes with required fields
        return pa.Table.from_arrays([cols[c] for c in names], names)

    return run


def remove_repeats(docs: DataFrame, keep_columns: bool = False, figures: str = "_dedup") -> DataFrame:
    """doc_id, text (what is kept, broken characters at a cut left out), n_bytes, n_removed, n_spans, kept_sha256.

    With ``keep_columns`` the further columns follow doc_id and text, and the figures are in one struct called ``figures``.
    ``kept_sha256`` is taken of the remaining bytes themselves.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "text")] if keep_columns else []
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    buckets = 2 * blocks
    cols = [F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("_block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if other:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in other]).alias("_row"))
    texts = docs.select(*cols)
    names = ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["_row"] if other else [])
    out = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    row_type = texts.schema["_row"].dataType if other else None
    if other:
        out += f", _row {row_type.simpleString()}"
    by_block = texts.groupBy("_block")
    told = by_block.applyInArrow(_send_phrases(buckets), _PHRASES).groupBy("_bucket")
    asks = told.applyInArrow(_ask, _ASK)
    sent = by_block.cogroup(asks.groupBy("_block")).applyInArrow(_send_bytes(buckets), _DICT)
    answers = told.cogroup(sent.groupBy("_bucket")).applyInArrow(_answer_windows, _REPLY)
    arrow = to_arrow_schema(StructType.fromDDL(out))
    marked = by_block.cogroup(answers.groupBy("_block")).applyInArrow(_mark(buckets, names, arrow), out)
    if not keep_columns:
        return marked.drop("_row")
    return marked.select("doc_id", "text", *[F.col(f"_row.`{c}`").alias(c) for c in other], F.struct(*names[2:6]).alias(figures))

"""Byte-level BPE ids of many texts at once.

The pre-token rule of the vocabulary is applied to whole slices of text with array operations, every distinct pre-token
is encoded once, and the ids are gathered.  The result equals ``Tokenizer.encode(text, add_special_tokens=False)``.
Texts with characters whose class could depend on the Unicode version (beyond Latin, or rare controls), or with the
string of an added token, go through the tokenizer as they are.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from .bytetext import mix, powers

_TOP = 0x250
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)
#: Distinct pre-tokens kept by a worker; beyond it the store starts anew.
STORE = 1 << 20


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.full(_TOP + 1, _OTHER, np.uint8)
    for c in range(_TOP):
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            if regex.match(pattern, chr(c)):
                kinds[c] = kind
    kinds[[*range(0x1C, 0x20), 0x85, 0xAD, _TOP]] = _UNSURE
    return kinds, mix(np.arange(1, _TOP + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pretoken_starts(cp: np.ndarray, kind: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: runs of one class, a run taking one space before it, and English contractions.

    ``off`` are row offsets; the last space of a run before other text goes to that text, a row's last run stays whole.
    """
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[off] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    end = np.flatnonzero(run[1:] & (kind == _SPACE))  # last character of a run of spaces
    end = end[~first[end + 1]]
    start[end] = True
    start[end[cp[end] == 32] + 1] = False
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    if len(quote):
        a = cp[quote + 1]
        two = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~first[quote + 2], cp[two], 0)
        size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
        for x in ("re", "ve", "ll"):
            size = np.where((a == ord(x[0])) & (b == ord(x[1])), 2, size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class BatchEncoder:
    """Encodes slices of texts; keeps the ids of distinct pre-tokens."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.encode_piece = self._piece_encoder(spec)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _piece_encoder(self, spec: dict):
        """Merges by rank where ids follow the merges, which is the same rule and faster; else the tokenizer itself."""
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        extra = [b for b in range(256) if b not in set(plain)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(extra)}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in set(self.added)}
        fast = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        return fast.encode_ordinary

    def encode(self, text: str, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, and id offsets; ``off`` are row offsets in code points."""
        kinds, salt = _classes()
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        small = np.minimum(cp, _TOP)
        kind = kinds[small]
        rows = len(off) - 1
        odd = np.zeros(rows, bool)
        odd[np.searchsorted(off, np.flatnonzero(kind == _UNSURE), "right") - 1] = True
        for token in self.added:
            p = text.find(token)
            while p >= 0:
                odd[np.searchsorted(off, p, "right") - 1] = True
                p = text.find(token, p + 1)
        if len(cp) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        starts = pretoken_starts(cp, kind, off)
        ends = np.append(starts[1:], len(cp))
        row = np.searchsorted(off, starts, "right") - 1
        plain = ~odd[row]
        starts, ends, row = starts[plain], ends[plain], row[plain]
        pw, inv = powers(len(cp) + 1)
        prefix = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(salt[small] * pw[: len(cp)], out=prefix[1:], dtype=np.uint64)
        h = mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        slot = self._slots(uniq, starts[where], ends[where], text)
        size = self.size[slot][back]
        begin = self.at[slot][back]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        cut = total[np.searchsorted(row, np.arange(rows + 1))]
        if odd.any():
            parts = [np.array(self.tokenizer.encode(text[off[r] : off[r + 1]], add_special_tokens=False).ids, np.uint32) if odd[r] else ids[cut[r] : cut[r + 1]] for r in range(rows)]
            ids, cut = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, cut

    def _slots(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, text: str) -> np.ndarray:
        if len(self.keys) + len(keys) > STORE:
            self._clear()
        pos = np.searchsorted(self.keys, keys)
        known = pos < len(self.keys)
        known[known] = self.keys[pos[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            ids = [self.encode_piece(text[s:e]) for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
            at = np.concatenate(([0], np.cumsum(size)))[:-1] + len(self.flat)
            self.flat = np.concatenate((self.flat, flat))
            self.keys = np.insert(self.keys, pos[new], keys[new])
            self.at = np.insert(self.at, pos[new], at)
            self.size = np.insert(self.size, pos[new], size)
            pos = np.searchsorted(self.keys, keys)
        return pos


@lru_cache(4)
def encoder(path: str) -> BatchEncoder:
    """One encoder for each worker process and vocabulary."""
    return BatchEncoder(path)

"""A run-length index over short phrases: the Burrows-Wheeler transform as runs, with suffix positions at run ends.

Built with array operations inside one task over a bounded set of phrases.  Only what lies at the borders of runs is
kept: where the first suffix of a run starts, where the last suffix of the run before it starts, and how many symbols the
two have in common.  Within a run all suffixes follow the same symbol, so that the neighbour of any other suffix is that of
the suffix one symbol longer, moved by one, and their match is one symbol shorter.  A pass over the text from sample to
sample therefore streams the matching statistics of every position (nearest earlier suffix in order, length of the match)
without a suffix array.
"""

from __future__ import annotations

import numpy as np

def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, and the keys in it; as one sort of numbers where key and place fit in 63 bits."""
    place = len(key).bit_length()
    if bits + place > 63:
        order = np.argsort(key)
        return order, key[order]
    both = (key << place) | np.arange(len(key))
    both.sort()
    return both & ((1 << place) - 1), both >> place


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of ``text`` (bytes + 1, 0 as separator) in order; no two have more than ``longest`` symbols in common."""
    n = len(text)
    used = np.zeros(int(text.max(initial=0)) + 1, bool)
    used[text] = True
    symbols = np.cumsum(used)  # from 1, as 0 is behind the end
    bits, width = int(symbols[-1]).bit_length(), n.bit_length()
    h = max(1, (63 - width) // bits)
    padded = np.concatenate((symbols[text], np.zeros(h, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = (key << bits) | padded[j : j + n]
    order, key = _sorted(key, h * bits)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    # Ranks are the place of a group's first suffix; only suffixes in groups of two or more are sorted again.
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    while h < longest and len(at):
        suffix = order[at]
        group = rank[suffix]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        sort, pair = _sorted((group << width) | follow, 2 * width)
        suffix = suffix[sort]
        order[at] = suffix
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        # Groups lie side by side in ``at`` as in the order, and sorting keeps each in its places.
        rank[suffix] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` (never the same) have in common, seven at a time."""
    n = len(text)
    padded = np.concatenate((text + 1, np.zeros(7, np.int64)))
    word = np.zeros(n + 1, np.int64)
    for j in range(7):
        word = (word << 9) | padded[j : j + n + 1]
    common = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        live = live[word[a[live] + common[live]] == word[b[live] + common[live]]]
        common[live] += 7
    for width in (4, 2, 1):  # the rest is under seven
        word_of = word >> (9 * (7 - width))
        common += width * (word_of[np.minimum(a + common, n)] == word_of[np.minimum(b + common, n)])
    return common


class RunLengthIndex:
    """Distinct phrases (concatenated bytes, lengths) as runs of their transform, each sampled at its border."""

    def __init__(self, data: np.ndarray, size: np.ndarray) -> None:
        self.size = size
        self.first = np.concatenate(([0], np.cumsum(size + 1)))  # each phrase follows its separator
        text = np.zeros(self.first[-1] + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[self.first] = False
        text[inside] = data.astype(np.int64) + 1
        order = suffix_order(text, 2 * int(size.max(initial=0)) + 3)
        bwt = text[order - 1]
        bwt[order == 0] = -1  # nothing is before the whole text
        start = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        del bwt
        begin, end = order[start], order[start - 1]  # the first row of a run, the last of the run before
        del order
        common = common_prefix(text, begin[1:], end[1:])
        by = np.argsort(begin)
        #: Sampled positions in text order, their neighbours in suffix order, and the lengths of these matches.
        self.at = begin[by]
        self.other = np.concatenate(([-1], end[1:]))[by]
        self.common = np.concatenate(([0], common))[by]
        self.symbols = len(text)

    @property
    def runs(self) -> int:
        return len(self.at)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position the suffix before it in order, and the length of their match (0 or less: none)."""
        here = np.arange(self.symbols)
        reach = np.diff(np.append(self.at, self.symbols))
        return np.repeat(self.other - self.at, reach) + here, np.repeat(self.common + self.at, reach) - here

    def least(self, doc: np.ndarray, depth: int) -> np.ndarray:
        """For each window of ``depth`` bytes of each phrase in turn, the least document of a phrase that has these bytes.

        Windows with equal bytes are neighbours in suffix order: their matches of ``depth`` symbols or more link them to
        chains, and a chain is answered once.
        """
        count = np.maximum(self.size - depth + 1, 0)
        cum = np.cumsum(count) - count
        window = np.repeat(self.first[:-1] + 1 - cum, count) + np.arange(int(count.sum()))
        other, length = self.stream()
        linked = np.flatnonzero(length[window] >= depth)
        slot = np.zeros(self.symbols, np.int64)
        slot[window] = np.arange(len(window))
        chain = np.arange(len(window))
        chain[linked] = slot[other[window[linked]]]
        while len(linked):
            further = chain[chain[linked]]
            moved = further != chain[linked]
            chain[linked] = further
            linked = linked[moved]
        out = np.full(len(window), np.iinfo(np.int64).max)
        np.minimum.at(out, chain, np.repeat(doc, count))
        return out[chain]

"""Compressed full-text index: a Burrows-Wheeler transform of word ids in a wavelet matrix.

Bits are packed 64 to a word with a running count for each word, so a level
takes 1.5 bits a symbol. Ranks, backward-search steps and range minima are
computed for many queries at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.zeros = int(len(bits) - self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols in a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, self.depth = [], max(1, int(top).bit_length())
        left = symbols
        for bit in range(self.depth - 1, -1, -1):
            own = ((left >> bit) & 1).astype(bool)
            self.levels.append(BitVector(own))
            left = np.concatenate([left[~own], left[own]])
        # where the block of each symbol starts after all levels
        every = np.arange(top + 1)
        self.start = self._descend(every, np.zeros(top + 1, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bit in zip(self.levels, range(self.depth - 1, -1, -1), strict=True):
            ones = level.rank(at)
            at = np.where((symbol >> bit) & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.start[symbol]


class RangeMinimum:
    """Minima of ranges by a sparse table."""

    def __init__(self, values: np.ndarray):
        rows, width = [values.astype(np.int32)], 1
        while 2 * width <= len(values):
            last = rows[-1]
            rows.append(np.concatenate([np.minimum(last[:-width], last[width:]), last[len(last) - width :]]))
            width *= 2
        self.table = np.stack(rows)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low:high]; ranges are not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high - (1 << level)])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by (at least) their first ``depth`` symbols, by prefix doubling."""
    order = np.argsort(text, kind="stable")
    rank = np.empty(len(text), dtype=np.int64)
    rank[order] = np.cumsum(np.diff(text[order], prepend=text[order[:1]]) != 0)
    width = 1
    while width < depth and rank[order[-1]] + 1 < len(text):
        key = rank * (len(text) + 1)
        key[: len(text) - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        width *= 2
    return order


class FmIndex:
    """Index of passages (arrays of word ids from 1 on), each with the number of its first document."""

    def __init__(self, passages: list[np.ndarray], owner: np.ndarray, depth: int):
        self.base = np.concatenate([[0], np.cumsum([len(p) + 1 for p in passages])])
        text = np.zeros(self.base[-1], dtype=np.int64)  # 0 ends each passage
        for at, p in zip(self.base, passages):
            text[at : at + len(p)] = p
        self.text, self.top = text, int(text.max(initial=0))
        order = suffix_order(text, depth + 2)
        self.matrix = WaveletMatrix(text[order - 1], self.top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        document = np.repeat(owner, np.diff(self.base))
        self.owners = RangeMinimum(document[order])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward-search step: the suffix ranges of symbol + pattern."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.first[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def matches(self, owner: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
        """For each passage, the intervals (start, end) of ``least`` or more words that also occur under a smaller owner.

        Backward search from the passage's end finds the longest match there;
        the next search ends where a further match still could. When a match
        is too short, one search for the words that all remaining windows
        have in common can rule them out together.
        """
        n = len(self.base) - 1
        length = np.diff(self.base) - 1
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        who = np.flatnonzero(length >= least)
        end, at = length[who].copy(), length[who].copy()
        low, high = np.zeros(len(who), dtype=np.int64), np.full(len(who), len(self.text))
        core = np.full(len(who), -1)  # >= 0: a search for the common words, down to this one
        after = np.zeros(len(who), dtype=np.int64)  # where to go on if the common words do occur
        while len(who):
            symbol = self.text[self.base[who] + at - 1]
            lo, hi = self.extend(symbol, low, high)
            good = hi > lo
            good[good] = self.owners.least(lo[good], hi[good]) < owner[who[good]]
            low, high, at = np.where(good, lo, low), np.where(good, hi, high), np.where(good, at - 1, at)
            keep = np.ones(len(who), dtype=bool)
            searching = core >= 0
            keep[searching & ~good] = False  # no remaining window occurs
            proven = np.flatnonzero(searching & good & (at == core))
            again = [(k, after[k]) for k in proven]
            for k in np.flatnonzero(~searching & (~good | (at == 0))):
                i, e = int(at[k]), int(end[k])
                if e - i >= least:
                    found[who[k]].append((i, e))
                onward = min(e - 1, i + least - 1)
                if i == 0 or onward < least:
                    keep[k] = False
                elif i < least:
                    core[k], after[k] = i - 1, onward
                    at[k], low[k], high[k] = least, 0, len(self.text)
                else:
                    again.append((k, onward))
            for k, e in again:
                core[k], end[k], at[k], low[k], high[k] = -1, e, e, 0, len(self.text)
            if not keep.all():
                who, end, at, low, high, core, after = (x[keep] for x in (who, end, at, low, high, core, after))
        return found

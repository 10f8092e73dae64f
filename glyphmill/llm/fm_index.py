"""An FM-index over a sequence of small integers, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Prefix doubling; after each pass only suffixes whose rank is still shared are sorted again."""
    n = len(t)
    # The first key packs as many symbols as fit into 62 bits.
    bits = max(1, int(t.max(initial=0) + 1).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: max(n - j, 0)] |= t[j:] + 1 if j else t + 1
    sa = np.argsort(key, kind="stable")
    open_at, group = np.arange(n), key[sa]
    rank = np.empty(n, np.int64)
    while True:
        # Rank: the place in `sa` where the suffix's group starts.
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        first = np.maximum.accumulate(np.where(new, open_at, 0))
        rank[sa[open_at]] = first
        alone = new & np.append(new[1:], True)
        open_at = open_at[~alone]
        if not len(open_at):
            return sa
        some = sa[open_at]
        after = some + k
        key = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        sa[open_at] = some[order]
        group = key[order]
        k *= 2


class WaveletMatrix:
    """rank and access over a sequence, one bit vector with block counts for each bit of its symbols."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.levels = len(seq), []
        seq = np.asarray(seq, np.int64)
        for bit in range(bits - 1, -1, -1):
            b = ((seq >> bit) & 1).astype(bool)
            packed = np.packbits(np.append(b, np.zeros(64 + -len(b) % 64, bool)), bitorder="little").view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            zeros = len(b) - int(b.sum())
            self.levels.append((bit, packed, counts, zeros))
            seq = np.concatenate([seq[~b], seq[b]])

    @staticmethod
    def _ones(packed, counts, i):
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        lo, hi = np.zeros_like(at), at.copy()
        for bit, packed, counts, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            a, b = self._ones(packed, counts, lo), self._ones(packed, counts, hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = at.copy(), np.zeros_like(at)
        for _, packed, counts, zeros in self.levels:
            one = ((packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(packed, counts, at)
            at = np.where(one, zeros + ones, at - ones)
            out = out * 2 + one
        return out


class FMIndex:
    """Counts and locates patterns. Symbols of the text: 1 and more; 0 is its end."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        t = np.append(np.asarray(text, np.int64), 0)
        sa = suffix_array(t)
        top = int(t.max()) + 1
        self.bits = max(1, (top - 1).bit_length())
        self.before = np.zeros(top + 1, np.int64)
        np.cumsum(np.bincount(t, minlength=top), out=self.before[1:])
        self.bwt = WaveletMatrix(t[sa - 1], self.bits)
        self.n, self.top = len(t), top
        self.marked = sa % sample == 0
        self.nth = np.cumsum(self.marked) - 1
        self.sampled = sa[self.marked]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of every pattern (a row of `patterns`, as long as `lengths` says), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            on = np.flatnonzero((step < lengths) & (lo < hi))
            c = patterns[on, lengths[on] - 1 - step].astype(np.int64)
            known = c < self.top
            hi[on[~known]] = lo[on[~known]]
            on, c = on[known], c[known]
            lo[on], hi[on] = self.before[c] + self.bwt.rank(c, lo[on]), self.before[c] + self.bwt.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text up to the next sampled position."""
        rows, steps = rows.copy(), np.zeros_like(rows)
        left = np.flatnonzero(~self.marked[rows])
        while len(left):
            c = self.bwt.access(rows[left])
            rows[left] = self.before[c] + self.bwt.rank(c, rows[left])
            steps[left] += 1
            left = left[~self.marked[rows[left]]]
        return self.sampled[self.nth[rows]] + steps

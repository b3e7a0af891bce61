"""FM-index over many short texts: suffix order, wavelet matrix with packed bits, backward search of many patterns at once (numpy)."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more (prefix doubling from packed words; only undecided groups are sorted again)."""
    n, per = len(codes), 63 // bits
    key = np.zeros(n, np.int64)
    for j in range(per):
        key <<= bits
        key[: n - j] |= codes[j:]
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    new = np.r_[True, k[1:] != k[:-1]]
    at = np.arange(n)
    group = np.maximum.accumulate(np.where(new, at, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    while per < depth:
        un = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(un):
            break
        s = sa[un]
        nxt = s + per
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        k = group[un] * (n + 1) + second + 1
        o = np.argsort(k, kind="stable")
        sa[un], k = s[o], k[o]
        diff = np.r_[True, k[1:] != k[:-1]]
        new[un] = diff
        group[un] = np.maximum.accumulate(np.where(diff, un, 0))
        rank[sa[un]] = group[un]
        per *= 2
    return sa


class FMIndex:
    """Index of ``codes`` (0: separator, never searched; 1..sigma). Patterns up to ``depth`` symbols can be searched."""

    def __init__(self, codes: np.ndarray, sigma: int, depth: int):
        self.bits = max(1, int(sigma).bit_length())
        self.sa = suffix_order(codes, self.bits, depth)
        seq = codes[self.sa - 1]  # the Burrows-Wheeler transform; row 0 wraps around to a separator
        first = np.searchsorted(np.sort(codes), np.arange((1 << self.bits) + 1))[:-1]
        self.words, self.blocks, self.zeros = [], [], []
        starts = np.zeros(1 << self.bits, np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view(np.uint64)
            self.words.append(words)
            self.blocks.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int32)].astype(np.int32))
            one = bit.astype(bool)
            self.zeros.append(int(len(bit) - one.sum()))
            seq = np.r_[seq[~one], seq[one]]
        u, where = np.unique(seq, return_index=True)
        starts[u] = where
        self.shift = first - starts

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows below ``symbol`` + (pattern at row ``at``): one backward step for one end of the intervals."""
        i = at
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1
            w = i >> 6
            below = self.words[k][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            rank = self.blocks[k][w] + np.bitwise_count(below)
            i = np.where(one == 1, self.zeros[k] + rank, i - rank)
        return self.shift[symbol] + i

    def search(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of text[start:end] for each pattern: (pattern numbers, first row, row after the last) of those met ``least`` times."""
        live = np.arange(len(start))
        lo, hi, at = np.zeros(len(start), np.int64), np.full(len(start), len(self.sa), np.int64), end.astype(np.int64).copy()
        done: list[tuple] = []
        while len(live):
            at -= 1
            both = self.step(np.r_[text[at], text[at]].astype(np.int64), np.r_[lo, hi])
            lo, hi = both[: len(live)], both[len(live) :]
            keep = hi - lo >= least
            over = keep & (at <= start[live])
            if over.any():
                done.append((live[over], lo[over], hi[over]))
            keep &= ~over
            live, lo, hi, at = live[keep], lo[keep], hi[keep], at[keep]
        if not done:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*done))

"""FM-index over a sequence of words, in numpy.

The text is a list of runs of symbols 1..sigma, each closed by a break. Breaks
compare by position, so no comparison runs past one, and the suffix array
sorts only what is still tied, in about log2(longest repeated run) rounds. The Burrows-Wheeler
transform is held as a wavelet matrix (one bit plane per symbol bit, with
prefix counts); positions are sampled every ``sample`` symbols and at the start
of each run, so that locating never has to step over a break.
"""

from __future__ import annotations

import numpy as np


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Prefix doubling by groups. ``ranks``: non-negative ints below 2^31, no two suffixes equal.

    As many symbols as fit one key sort the suffixes first; after that only groups of suffixes
    that are still equal are sorted again, by the ranks of what follows the equal part."""
    n = len(ranks)
    if not n:
        return np.zeros(0, np.int64)
    top = int(ranks.max()) + 2
    depth = max(1, min(63 // top.bit_length(), 3))
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key *= top
        key[:n - i] += ranks[i:].astype(np.int64) + 1
    order = np.argsort(key)
    rank = np.empty(n, np.int32)
    # Places in the order whose group is not settled, and the suffixes' ranks: the first place of their group.
    place = np.arange(n, dtype=np.int32)
    key = key[order]
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        first = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
        rank[order[place]] = first
        alone = new & np.r_[new[1:], True]
        place, group = place[~alone], first[~alone]
        if not len(place):
            return order
        # A group's suffixes agree in ``depth`` symbols; the rest of one of them may be empty.
        rest = order[place] + depth
        follows = np.where(rest < n, rank[np.minimum(rest, n - 1)], -1)
        key = group.astype(np.int64) * (n + 1) + follows + 1
        turn = np.argsort(key)
        order[place], key = order[place][turn], key[turn]
        depth *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 32):
        """``text``: symbols, 0 for a break; the last one is a break."""
        n = len(text)
        breaks = text == 0
        n_breaks = int(breaks.sum())
        ranks = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + n_breaks)
        sa = suffix_array(ranks)
        bwt = text[sa - 1]  # position 0 is preceded by the closing break
        sigma = int(text.max(initial=0)) + 1
        # first[c]: suffixes that start with a smaller symbol
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))].astype(np.int64)
        self.bits = max(1, sigma.bit_length())
        self.planes, self.zeros, at = [], [], bwt.astype(np.int32)
        for b in reversed(range(self.bits)):
            ones = (at & (1 << b)) != 0
            plane = np.zeros(n + 1, np.int32)
            np.cumsum(ones, dtype=np.int32, out=plane[1:])
            self.planes.append(plane)
            self.zeros.append(n - int(plane[-1]))
            at = np.concatenate([at[~ones], at[ones]])
        starts = np.r_[True, breaks[:-1]]
        marked = starts | (np.arange(n) % sample == 0)
        self.marked = marked[sa]
        self.slot = np.cumsum(self.marked) - 1
        self.positions = sa[self.marked]
        self.bwt = bwt

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` among the first ``i`` symbols of the transform, for arrays of both."""
        low, i = np.zeros_like(i), i.copy()
        for plane, zeros, b in zip(self.planes, self.zeros, reversed(range(self.bits))):
            one = (c >> b) & 1 == 1
            for x in (low, i):
                ones = plane[x]
                x[:] = np.where(one, zeros + ones, x - ones)
        return i - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many patterns at once. ``patterns``: one per row, symbols from the left;
        symbols that the text lacks are fine. Returns the suffix ranges [low, high)."""
        n = len(self.bwt)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step].astype(np.int64)
            known = c + 1 < len(self.first)
            c = np.where(known, c, 0)
            for x in (low, high):
                x[live] = np.where(known, self.first[c] + self.rank(c, x[live]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back until a sampled one."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.marked[rows[left]]
            out[left[done]] = self.positions[self.slot[rows[left[done]]]] + steps
            left = left[~done]
            c = self.bwt[rows[left]].astype(np.int64)
            rows[left] = self.first[c] + self.rank(c, rows[left])
            steps += 1
        return out

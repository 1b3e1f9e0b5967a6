"""Canonical length-limited Huffman coding of ids, in numpy.

Codes are assigned in order of (length, id), so the lengths alone define
them. A code's bits are written from its highest one; decoding looks the next
``limit`` bits up in one table and runs many segments of a block side by side,
each from its own checkpoint.
"""

from __future__ import annotations

import numpy as np

#: Longest code; raised where there are more ids than it could tell apart.
LIMIT = 18
#: Ids between two checkpoints.
EVERY = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that do not
    occur. A single id gets one bit."""
    ids = np.flatnonzero(counts)
    n, lengths = len(ids), np.zeros(len(counts), np.int64)
    if n <= 1:
        lengths[ids] = 1
        return lengths
    limit = max(limit, (n - 1).bit_length())
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[ids].astype(np.int64)
    row, leaves_before = leaves, []
    for level in range(limit):
        if level:
            pairs = row[:len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
            row = np.concatenate([leaves, pairs])
            order = np.argsort(row, kind="stable")
            row, is_leaf = row[order], order < n
        else:
            is_leaf = np.ones(n, bool)
        leaves_before.append(np.r_[0, np.cumsum(is_leaf)])
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for before in reversed(leaves_before):
        chosen = int(before[take])
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[ids] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id (0 where its length is 0)."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    codes = np.zeros(len(lengths), np.uint64)
    if len(ids):
        top = int(lengths[ids[-1]])
        # In units of the longest code, each code starts where the one before ends.
        width = np.left_shift(np.uint64(1), (top - lengths[ids]).astype(np.uint64))
        start = np.r_[np.uint64(0), np.cumsum(width, dtype=np.uint64)[:-1]].astype(np.uint64)
        codes[ids] = start >> (top - lengths[ids]).astype(np.uint64)
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(self.lengths)
        self.top = int(self.lengths.max(initial=1))
        self._table: np.ndarray | None = None

    def encode(self, ids: np.ndarray, counts: np.ndarray, every: int = EVERY) -> tuple[np.ndarray, ...]:
        """Code documents of ``counts`` ids each (at least one), every one from a new byte on. Returns the bytes, bytes per
        document, the bits of each ``every`` ids of a document, and how many such numbers each document has."""
        if not len(ids):
            return np.zeros(0, np.uint8), counts * 0, np.zeros(0, np.int64), counts * 0
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        last = np.cumsum(counts) - 1
        bits = np.diff(ends[last], prepend=0)
        sizes = (bits + 7) // 8
        pad = np.cumsum(sizes * 8) - sizes * 8 - (ends[last] - bits)  # by how much a document is moved
        starts = ends - lengths + np.repeat(pad, counts)
        # Each code lies in a 64-bit window that begins at its 32-bit word.
        word = starts >> 5
        value = self.codes[ids] << (64 - (starts & 31) - lengths).astype(np.uint64)
        edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        at = word[edge]
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[at] += np.add.reduceat(value >> np.uint64(32), edge)
        out[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), edge)
        marks = -(-counts // every)
        segment = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
        stop = np.repeat(last - counts + 1, marks) + np.minimum((segment + 1) * every, np.repeat(counts, marks)) - 1
        return out.astype(">u4").view(np.uint8)[:int(sizes.sum())], sizes, np.diff(ends[stop], prepend=0), marks

    def table(self) -> np.ndarray:
        """Indexed by the next ``top`` bits: id * 32 + length."""
        if self._table is None:
            ids = np.flatnonzero(self.lengths)
            ids = ids[np.lexsort((ids, self.lengths[ids]))]
            table = np.repeat(ids * 32 + self.lengths[ids], 1 << (self.top - self.lengths[ids]))
            self._table = np.zeros(1 << self.top, np.int64)
            self._table[:len(table)] = table
        return self._table

    def decode(self, bits: bytes, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of segments that begin at bit ``offsets`` and hold ``sizes`` ids, one after the other."""
        table, top = self.table(), np.uint64(self.top)
        words = np.frombuffer(bits + b"\0" * (12 + -len(bits) % 4), ">u4").astype(np.uint64)
        out = np.empty(int(sizes.sum()), np.int64)
        # Longest segments first, so that those still running are a prefix.
        order = np.argsort(-sizes, kind="stable")
        at, target = offsets[order].astype(np.int64), (np.cumsum(sizes) - sizes)[order]
        left = sizes[order]
        running = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right") if len(left) else []
        for step, n in enumerate(running):
            now = at[:n]
            word = now >> 5
            window = (words[word] << np.uint64(32)) | words[word + 1]
            hit = table[((window << (now & 31).astype(np.uint64)) >> (np.uint64(64) - top)).astype(np.int64)]
            out[target[:n] + step] = hit >> 5
            now += hit & 31
        return out

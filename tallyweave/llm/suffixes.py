"""Blockwise suffix sorting with a difference cover, as far as suffixes differ within `length` bytes.

A difference cover D of period v holds, for any two positions, a shift below v that brings both to
positions whose residues are in D. Only these sample positions get ranks: first of their v bytes, then
of 2v, 4v, ... by joining the ranks of two stretches. The suffixes asked for are sorted bucket by
bucket, a bucket being those with equal first v and last v bytes of their length; within a bucket, long
ties are split three ways around pivots by the ranks of the samples that a common shift leads to, so no
suffix is read beyond its ends. Memory is bounded by the block.
"""

from __future__ import annotations

import numpy as np

#: Perfect difference covers by period (Singer difference sets).
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 73: (1, 2, 4, 8, 16, 32, 37, 55, 64)}


class Cover:
    """A cover for a length: its period, the depth of the ranks, and the shift for each two residues."""

    def __init__(self, length: int):
        self.length = length
        self.v = max(v for v in COVERS if v * 2 <= max(length - v, 14))
        own = set(COVERS[self.v])
        self.in_cover = np.array([r in own for r in range(self.v)])
        self.shift = np.array([[next(d for d in range(self.v) if (a + d) % self.v in own and (b + d) % self.v in own) for b in range(self.v)] for a in range(self.v)])
        self.doublings = 0
        while self.v << (self.doublings + 1) <= length - self.v:
            self.doublings += 1
        self.depth = self.v << self.doublings


def _ranks(words, at, v: int):
    """Dense ranks of the v bytes from each position; words[p] is the big-endian integer of the 8 bytes from p."""
    keys = []
    for k in range(0, v, 8):
        w = words[at + k]
        if v - k < 8:
            w = w >> np.uint64(8 * (8 - (v - k)))
        keys.append(w)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for w in keys:
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated(text, starts, cover: Cover, owner=None):
    """Which of the starts have the same `length` bytes as another of them. Each start has that many bytes left.

    With owners (integers; negative ones stand for several), only starts count that another owner has too.
    """
    n, v, length = len(text), cover.v, cover.length
    hit = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return hit
    padded = np.zeros(n + length + v + 16, np.uint8)
    padded[:n] = text
    wide = padded.astype(np.uint64)
    words = np.zeros(n + length + v + 8, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | wide[k : k + len(words)]
    sample = np.flatnonzero(cover.in_cover[np.arange(n + length) % v])
    place = np.full(n + 2 * length + cover.depth, -1, np.int64)
    place[sample] = np.arange(len(sample))
    every = _ranks(words, np.concatenate([sample, starts, starts + length - v]), v)
    rank, first, last = every[: len(sample)], every[len(sample) : len(sample) + len(starts)], every[len(sample) + len(starts) :]
    depth = v
    for _ in range(cover.doublings):
        later = place[sample + depth]
        joined = rank * (len(every) + 1) + np.where(later >= 0, rank[later] + 1, 0)
        rank = np.unique(joined, return_inverse=True)[1]
        depth *= 2
    # buckets: equal first and last v bytes
    order = np.lexsort((last, first))
    first, last, own = first[order], last[order], starts[order]
    edge = np.ones(len(own), bool)
    edge[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    bucket = np.cumsum(edge) - 1
    left = np.arange(len(own))
    alone = np.bincount(bucket) == 1
    left = left[~alone[bucket]]
    while len(left):
        group = bucket[left]
        head = np.ones(len(left), bool)
        head[1:] = group[1:] != group[:-1]
        pivot = own[left[np.flatnonzero(head)[np.cumsum(head) - 1]]]
        here = own[left]
        d = cover.shift[pivot % v, here % v]
        same = rank[place[pivot + d]] == rank[place[here + d]]
        more = (length - depth - d) // v * v
        far = np.flatnonzero(more > 0)
        same[far] &= rank[place[pivot[far] + d[far] + more[far]]] == rank[place[here[far] + d[far] + more[far]]]
        which = np.cumsum(head) - 1
        if owner is None:
            met = np.bincount(which[same], minlength=which[-1] + 1) > 1
        else:
            own_of = owner[order[left[same]]]
            low, high = np.full(which[-1] + 1, np.iinfo(np.int64).max), np.full(which[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, which[same], own_of)
            np.maximum.at(high, which[same], own_of)
            met = (low != high) | (low < 0)
        hit[order[left[same & met[which]]]] = True
        rest = left[~same]
        counts = np.bincount(bucket[rest], minlength=len(alone))
        left = rest[counts[bucket[rest]] > 1]
    return hit

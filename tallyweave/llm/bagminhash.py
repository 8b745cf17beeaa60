"""BagMinHash signatures of multisets.

Each shingle owns Poisson processes over (weight, time), one for each dyadic level of the weight axis:
(0,1], (1,2], (2,4], (4,8] and so on, with a rate as wide as the level. A multiset in which the shingle
occurs w times sees the points with weight coordinate up to w: whole levels below w, and of the level
that holds w the points on its lower side, told by splitting the level in halves. Each point falls on
one of the registers, which keep their earliest points. So two registers agree with the probability of
the weighted Jaccard similarity. A process ends for a text when its next point comes after the latest
of the text's registers, which leaves a few points for each shingle.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed

_GAP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)


def _unit(h):
    """A number in (0, 1] from a hash."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(hashes, counts, owner, n_texts: int, registers: int = 128):
    """Earliest times of each text's registers, as an array (texts, registers); infinity where a text has nothing."""
    out = np.full((n_texts, registers), np.inf)
    if not len(hashes):
        return out
    # streams: a row for each shingle and level; a level's points count up to `share` of its width
    n_levels = 1 + np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    rows = np.repeat(np.arange(len(hashes)), n_levels)
    level = np.arange(len(rows)) - np.repeat(np.cumsum(n_levels) - n_levels, n_levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low).astype(np.float64)
    share = np.minimum((counts[rows] - low) / width, 1.0)
    seed = mixed(hashes[rows] + level.astype(np.uint64) * _LEVEL)
    text, time = owner[rows], np.zeros(len(rows))
    flat, mask = out.ravel(), np.uint64(registers - 1)
    step = np.uint64(0)
    while len(text):
        seed = mixed(seed + _GAP + step)
        time = time - np.log(_unit(seed)) / width
        second = mixed(seed ^ _LEVEL)
        counted = (share >= 1) | (_unit(mixed(second + _GAP)) <= share)
        np.minimum.at(flat, text[counted] * registers + (second[counted] & mask).astype(np.int64), time[counted])
        present = np.unique(text)
        latest = np.zeros(n_texts)
        latest[present] = out[present].max(axis=1)
        alive = time < latest[text]
        text, time, seed, width, share = text[alive], time[alive], seed[alive], width[alive], share[alive]
        step += np.uint64(1)
    return out


def bands(times, size: int = 4):
    """A hash for each band of `size` registers: array (texts, bands).

    Times count in single precision, so that machines whose logarithms differ in the last place agree.
    """
    bits = times.astype(np.float32).view(np.uint32).astype(np.uint64)
    n, registers = bits.shape
    out = np.zeros((n, registers // size), np.uint64)
    for k in range(size):
        out = mixed(out + bits[:, k::size] + _GAP)
    return mixed(out + np.arange(registers // size, dtype=np.uint64) * _LEVEL)

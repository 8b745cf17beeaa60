"""Word shingles of many texts at once, as 64-bit hashes, with whole-array arithmetic.

Words are runs of ASCII letters, digits and underscores and of characters beyond ASCII, lower-cased.
A text of fewer words than a shingle has one shingle of all its words; without words it has none.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93 | 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h):
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int):
    """BASE**k and its inverse modulo 2**64, for k up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]), 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, b in enumerate((_BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True
_IS_WORD[128:] = True


def _next(factor):
    """The next power of STEP; integers wrap."""
    return np.uint64(int(factor) * int(_STEP) & (1 << 64) - 1)


def word_hashes(texts: list[str]):
    """(hash of each word, index of its text), in order."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([1] + [len(p) + 1 for p in parts])
    return hashes, np.searchsorted(limits, starts, "right") - 1


def shingle_hashes(texts: list[str], width: int = 5):
    """(hash of each shingle, index of its text), texts ascending."""
    words, owner = word_hashes(texts)
    n = len(words)
    counts = np.bincount(owner, minlength=len(texts))
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        factor = np.uint64(1)
        for k in range(width):
            total += words[k : n - width + 1 + k] * factor
            factor = _next(factor)
        whole = owner[: n - width + 1] == owner[width - 1 :]
        hashes, own = mixed(total[whole] + np.uint64(width)), owner[: n - width + 1][whole]
    else:
        hashes, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        firsts = np.cumsum(counts) - counts
        extra = np.zeros(len(short), np.uint64)
        factor = np.uint64(1)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += words[firsts[short[has]] + k] * factor
            factor = _next(factor)
        hashes = np.concatenate([hashes, mixed(extra + counts[short].astype(np.uint64))])
        own = np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        hashes, own = hashes[order], own[order]
    return hashes, own


def multisets(texts: list[str], width: int = 5):
    """(distinct shingle, its count, index of its text), ordered by text and shingle."""
    hashes, own = shingle_hashes(texts, width)
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    return hashes[at], np.diff(np.append(at, len(hashes))), own[at]

"""Boolean trigram queries of regular expressions, and an inverted index of a segment of texts.

The index holds the trigrams of the ASCII-lower-cased UTF-8 bytes. A query is True (every text may
match), a trigram, or ("and" | "or", parts). It never rules out a text that matches its expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

_parser, _ops = re._parser, re._constants

#: Largest set of strings that is carried on; larger ones are cut to shorter ends.
SET_LIMIT = 16
#: Largest character class that is spelled out.
CLASS_LIMIT = 8


def both(*parts):
    """Conjunction, without what says nothing."""
    flat = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == "and" else [p]:
            if q is not True and q not in flat:
                flat.append(q)
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def either(*parts):
    """Disjunction; True absorbs."""
    flat = []
    for p in parts:
        if p is True:
            return True
        for q in p[1] if isinstance(p, tuple) and p[0] == "or" else [p]:
            if q not in flat:
                flat.append(q)
    return flat[0] if len(flat) == 1 else ("or", flat)


def of_strings(strings) -> object:
    """Some string of the set occurs."""
    if not strings or min(map(len, strings)) < 3:
        return True
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [x for x in sets if not any(y < x for y in sets)]
    return either(*(both(*x) for x in sorted(map(sorted, least))))


def _cross(a, b):
    return {x + y for x, y in product(a, b)}


@dataclass
class Shape:
    """What is known of the strings an expression matches: all of them, or their starts and ends."""

    can_be_empty: bool
    exact: set | None
    starts: set
    ends: set
    query: object = True

    def loose(self) -> Shape:
        """The same without the exact set."""
        if self.exact is None:
            return self
        query = both(self.query, of_strings(self.exact))
        return Shape(self.can_be_empty, None, {s if len(s) < 3 else s[:2] for s in self.exact}, {s if len(s) < 3 else s[-2:] for s in self.exact}, query)

    def trimmed(self) -> Shape:
        if self.exact is not None:
            return self if len(self.exact) <= SET_LIMIT and max(map(len, self.exact), default=0) <= 24 else self.loose()
        query = both(self.query, of_strings(self.starts), of_strings(self.ends))
        starts, ends, n = {s[:2] for s in self.starts}, {s[-2:] for s in self.ends}, 1
        while n >= 0 and len(starts) > SET_LIMIT:
            starts, n = {s[:n] for s in starts}, n - 1
        n = 1
        while n >= 0 and len(ends) > SET_LIMIT:
            ends, n = {s[-n:] if n else b"" for s in ends}, n - 1
        return Shape(self.can_be_empty, None, starts, ends, query)


def _anything(can_be_empty: bool) -> Shape:
    return Shape(can_be_empty, None, {b""}, {b""})


_NOTHING = Shape(True, {b""}, set(), set())


def _then(x: Shape, y: Shape) -> Shape:
    empty = x.can_be_empty and y.can_be_empty
    query = both(x.query, y.query)
    if x.exact is not None and y.exact is not None:
        return Shape(empty, _cross(x.exact, y.exact), set(), set(), query).trimmed()
    starts = _cross(x.exact, y.starts) if x.exact is not None else x.starts | ((y.exact if y.exact is not None else y.starts) if x.can_be_empty else set())
    ends = _cross(x.ends, y.exact) if y.exact is not None else y.ends | ((x.exact if x.exact is not None else x.ends) if y.can_be_empty else set())
    if x.exact is None and y.exact is None and len(x.ends) * len(y.starts) <= SET_LIMIT:
        query = both(query, of_strings(_cross(x.ends, y.starts)))
    return Shape(empty, None, starts, ends, query).trimmed()


def _or(x: Shape, y: Shape) -> Shape:
    empty = x.can_be_empty or y.can_be_empty
    if x.exact is not None and y.exact is not None:
        return Shape(empty, x.exact | y.exact, set(), set(), either(x.query, y.query)).trimmed()
    x, y = x.loose(), y.loose()
    return Shape(empty, None, x.starts | y.starts, x.ends | y.ends, either(x.query, y.query)).trimmed()


def _class(items) -> Shape:
    chars: set[bytes] = set()
    for op, value in items:
        if op is _ops.LITERAL:
            chars.add(chr(value).lower().encode())
        elif op is _ops.RANGE and value[1] - value[0] < CLASS_LIMIT:
            chars |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
        else:
            return _anything(False)
    return Shape(False, chars, set(), set()) if len(chars) <= CLASS_LIMIT else _anything(False)


def _repeat(low: int, high, body) -> Shape:
    one, out = _shape(body), _NOTHING
    for _ in range(min(low, 3)):
        out = _then(out, one)
    if high == low and low <= 3:
        return out
    if low == 0:
        return _or(one, _NOTHING) if high == 1 else _anything(True)
    return _then(_then(out.loose(), _anything(True)), Shape(one.can_be_empty, None, {b""}, one.loose().ends))


def _shape(tree) -> Shape:
    out = _NOTHING
    for op, value in tree:
        if op is _ops.LITERAL:
            c = chr(value).lower().encode() if value < 128 else chr(value).encode()
            part = Shape(False, {c}, set(), set())
        elif op is _ops.IN:
            part = _class(value)
        elif op in (_ops.ANY, _ops.NOT_LITERAL):
            part = _anything(False)
        elif op is _ops.BRANCH:
            part, *rest = map(_shape, value[1])
            for other in rest:
                part = _or(part, other)
        elif op is _ops.SUBPATTERN:
            part = _shape(value[3])
        elif op is _ops.ATOMIC_GROUP:
            part = _shape(value)
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT, _ops.POSSESSIVE_REPEAT):
            part = _repeat(*value)
        elif op in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
            part = _NOTHING
        else:
            part = _anything(True)
        out = _then(out, part)
    return out


def query_of(pattern: str, flags: int = 0) -> object:
    """The trigram query of a regular expression. Case-blind expressions have to be ASCII ones."""
    return _shape(_parser.parse(pattern, flags)).loose().trimmed().query


def trigrams_in(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_in, query[1]))


class SegmentIndex:
    """Postings (ordinals of texts, ascending) of chosen trigrams in a segment of UTF-8 texts."""

    def __init__(self, trigrams):
        import numpy as np

        self.np = np
        self.names = sorted(trigrams)
        self.lookup = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.names):
            self.lookup[int.from_bytes(t, "big")] = i + 1
        self.postings: dict[bytes, object] = {}
        self.n = 0

    def build(self, texts: list[bytes]) -> None:
        np = self.np
        self.n = len(texts)
        self.postings = {}
        joined = b"\xff".join(texts).lower()
        raw = np.frombuffer(joined, np.uint8).astype(np.uint32)
        if len(raw) < 3 or not self.names:
            return
        codes = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        found = self.lookup[codes]
        at = np.flatnonzero(found)
        ends = np.cumsum([len(t) + 1 for t in texts])
        pairs = np.unique(found[at].astype(np.int64) * self.n + np.searchsorted(ends, at, "right"))
        kinds = pairs // self.n
        cuts = np.searchsorted(kinds, np.arange(1, len(self.names) + 2))
        docs = pairs % self.n
        self.postings = {t: docs[a:b] for t, a, b in zip(self.names, cuts, cuts[1:], strict=False) if b > a}

    def candidates(self, query):
        """Ordinals of the texts that the query leaves."""
        np = self.np
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(query, np.zeros(0, np.int64))
        parts = [self.candidates(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

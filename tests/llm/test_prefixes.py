"""The prefix trie against a plain one in Python, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallyweave.llm import common, prefixes

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth string"


def brute_rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def brute(rows):
    members = defaultdict(list)
    seqs = brute_rebuilt(rows)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        words = len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[b] for b in below) or 1
        saved[path] = sum(saved[b] for b in below) + (len(members[path]) - 1) * words
    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(seqs[c]) == len(path))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def of(spark, rows):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, prefixes.trie(spark, turns).collect()), key=key)


def test_small_table(spark):
    rows = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, prefixes.op12_prefix_trie(spark, "/root/testdata/sf0.001").collect()), key=key)
    assert got == sorted(brute(rows), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 130), 90):
        n = rng.choice([0, 1, 1, 2, 3, 5, 9, 17])
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "bot"]), " ".join(["a"] * rng.choice([1, 1, 1, 2]))) for t in range(n)]
    rng.shuffle(rows)
    # turns of one number are ordered by a digest here, by role and text there: keep one null turn a conversation
    seen = set()
    rows = [r for r in rows if r[1] is not None or not (r[0] in seen or seen.add(r[0]))]
    assert of(spark, rows) == sorted(brute(rows), key=key)


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 3)
    monkeypatch.setattr(prefixes, "BLOCK", 8)
    long = [(c, t, "user", f"turn {t}") for c in (40, 60) for t in range(70)]
    copies = [(c, t, "user", "same words here") for c in range(200, 260) for t in range(2)]
    rows = [*long, (40, 70, "user", "end"), *copies, (None, 0, "user", "x"), (1, None, None, None), (2, 0, "", ""), (3, 0, "u", ":a"), (4, 0, "u:", "a"), (80, 0, "user", "word " * 50_000), (80, 0, "user", "word " * 50_000), (100, 0, "é", "漢\x85字 x"), (21, 0, "a", "b")]
    assert of(spark, rows) == sorted(brute(rows), key=key)


def test_ties_are_settled_alike_everywhere(spark):
    rows = [(c, None if c == 20 else 1, r, t) for c in (0, 20, 40) for r, t in (("a", "x"), ("b", "y"), ("c", "z"))]
    got = of(spark, rows)
    assert got == of(spark, rows[::-1])
    assert [(r[1], r[3]) for r in got] == [(0, 3), (1, 3), (2, 3), (3, 3)]


def test_no_conversations(spark):
    assert of(spark, []) == []
    assert of(spark, [(None, 1, "a", "b")]) == []

"""SimHash classes against brute force over all pairs, and on odd tables."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tallyweave.llm import common, components, simhash

SF = "/root/testdata/sf0.001"


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """(doc_id, fingerprint, component_id) by a search from each row."""
    prints = [brute_print(t) for _, t in rows]
    near = [[j for j, y in enumerate(prints) if (x ^ y).bit_count() <= 4] for x in prints]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((doc_id, f"{prints[i]:016x}", min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def of(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, print long, root string")
    return sorted(map(tuple, simhash.classes(spark, docs).collect()), key=key)


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    got = sorted(map(tuple, simhash.op13_simhash(spark, SF).collect()))
    assert got == sorted(brute_classes(rows))
    assert len({r[2] for r in got}) < len(got)


def test_odd_rows(spark):
    long = "word of many " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\x0btwo"), (6, "one two"), (None, "é ü 漢字 x"), (7, "é ü 漢字 x"), (7, "é ü 漢字 x"), (9, "É ü 漢字 x"), (10, long), (11, long + "end"), (None, "alone here"), (12, "a\x85b c"), (7, "one two")]
    assert of(spark, rows) == sorted(brute_classes(rows), key=key)


def test_empty_table(spark):
    assert of(spark, []) == []


@pytest.mark.parametrize("bits", [3, 7, 12])
def test_every_pair_within_the_radius_meets(bits):
    rng = random.Random(bits)
    values = []
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 4])):
            values.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
    prints = np.unique(np.array(values, np.uint64))
    got = {}
    for bucket, held in simhash.sent(prints, bits):
        held = np.sort(held)
        for a, b in simhash.meetings(held, bucket, bits, most=500):
            for x, y in zip(held[a].tolist(), held[b].tolist(), strict=True):
                assert (x ^ y).bit_count() <= 4
                got.setdefault(x, set()).add(y)
                got.setdefault(y, set()).add(x)

    def joined(edges):
        place = {int(p): int(p) for p in prints}

        def top(x):
            while place[x] != x:
                x = place[x]
            return x

        for x, ys in edges.items():
            for y in ys:
                place[max(top(x), top(y))] = min(top(x), top(y))
        return {x: top(x) for x in place}

    wanted = {int(x): {int(y) for y in prints if 0 < int(x ^ y).bit_count() <= 4} for x in prints}
    assert joined(got) == joined(wanted)
    assert sum(map(len, wanted.values())) > 50


def test_trees():
    root = components.trees(6, np.array([4, 5, 1]), np.array([5, 3, 2]))
    assert root.tolist() == [0, 1, 1, 3, 3, 3]


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = random.Random(1)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (7, 7)]
    place = {x: x for p in pairs if p[0] != p[1] for x in p}

    def top(x):
        while place[x] != x:
            x = place[x]
        return x

    for a, b in pairs:
        if a != b:
            place[max(top(a), top(b))] = min(top(a), top(b))
    with common.Scratch(spark) as tables:
        found = components.roots(tables, spark.createDataFrame(pairs, "a long, b long"))
        assert sorted(map(tuple, found.collect())) == sorted((x, top(x)) for x in place)
        assert components.roots(tables, spark.createDataFrame([], "a long, b long")).count() == 0

"""Divergence of sources against plain arithmetic, and on odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tallyweave.llm import common, divergence

SCHEMA = "lang string, source string, text string, term string, n long, tile long"


def brute(rows, least=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        of = {s: shares(c) for s, c in groups.items()}
        of_lang = shares(whole)
        for s in groups:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(of[s][t], of_lang[t]), t) for t in kept if groups[s][t] and of[s][t] > of_lang[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return out


def of(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, divergence.divergence(spark, docs, **options).collect()))


@pytest.fixture
def small_parts(monkeypatch):
    """Several tiles, several blocks, both kinds of terms, counts passed on early."""
    monkeypatch.setattr(divergence, "TERMS", 7)
    monkeypatch.setattr(divergence, "GROUPS", 3)
    monkeypatch.setattr(divergence, "HELD", 50)


def test_small_table(spark):
    rows = [(r.lang, r.source, r.text) for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert sorted(map(tuple, divergence.op11_divergence(spark, "/root/testdata/sf0.001").collect())) == sorted(brute(rows))


@pytest.mark.parametrize("dense", [0, 2, 10**6])
def test_heavy_and_light_terms(spark, small_parts, monkeypatch, dense):
    monkeypatch.setattr(divergence, "DENSE", dense)
    rng = random.Random(7)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for _ in range(160):
        s = rng.randrange(11)
        rows.append((rng.choice(["en", "de"]), f"s{s}", " ".join(rng.choice(words[: 5 + 5 * s]) for _ in range(rng.randrange(12)))))
    assert of(spark, rows, least=2) == sorted(brute(rows, 2))


def test_odd_rows(spark, small_parts):
    texts = ["Same SAME same é É", None, "", "1 2 3 _ -", "a\x00b", "Straße STRASSE", "漢字 漢字", "x" * 40_000, "tie tie", "same a b é"]
    rows = [(lang, source, t) for t in texts for lang in (None, "", "en") for source in (None, "a", "a\x00", "b")] + [("xx", "only", "alone here"), ("yy", "p", "rare"), ("yy", "q", "words")]
    assert of(spark, rows) == sorted(brute(rows))


def test_empty_table(spark):
    assert of(spark, []) == []

"""Corpus operators on the rows that a cut would lose."""

import zlib
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tallyweave.llm import common, decontam, neardup, tokenids, toxicity

VOCAB = common.tokenizer_file("byte_bpe_50k.json")


# 1 ---------------------------------------------------------------- token files
@pytest.mark.parametrize("text", ["a\n\n<|endoftext|>b", "x  <|endoftext|>", "<|endoftext|>\n\n \n<|endoftext|>  y", "no marker\n\n here"])
def test_ids_around_an_added_token(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(VOCAB).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenids.ChunkEncoder(VOCAB).encode([text])[0], "<u2").tolist() == want


def test_token_files_with_an_added_token(spark):
    docs = spark.createDataFrame([(0, "a\n\n<|endoftext|>b"), (1, "c")], "doc_id long, text string")
    out = common.work_path(spark, "t")
    tokenids.write_token_files(spark, docs, out, VOCAB)
    crc = lambda *ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(map(tuple, tokenids.read_token_files(spark, out).collect())) == [(0, 0, 5, crc(64, 628, 50256, 65, 2)), (1, 5, 2, crc(66, 2))]


# 5 ---------------------------------------------------------------- decontamination
@pytest.mark.parametrize("n", range(8, 21))
def test_every_substitution_pattern_leaves_a_seed(n):
    gone = lambda places: not any(all(j + i not in places for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for j in range(n - len(m) + 1))
    assert [p for p in combinations(range(n), n - -(-n * 4 // 5)) if gone(set(p))] == []


def test_every_leak_of_ten_words(spark):
    item = [f"item{i}" for i in range(10)]
    pairs = list(combinations(range(10), 2))
    texts = ["before it " + " ".join(f"x{i}" if i in p else w for i, w in enumerate(item)) + " and after" for p in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.leaks(spark, docs, bench).collect()) == list(range(len(pairs)))


# 3 ---------------------------------------------------------------- toxicity
def test_rare_telling_term_behind_many_frequent_ones(spark):
    # 21,000 terms in every row, and one in the 4 toxic rows only
    common_terms = " ".join(f"t{k}" for k in range(21_000))
    docs = spark.createDataFrame([(i, common_terms + (" vile" if i < 4 else "")) for i in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(10)], "doc_id long, toxic int")
    assert toxicity.fit(spark, docs, labels).weights.get("vile", 0) > 0


# pipeline --------------------------------------------------------- rows with null or shared ids
BASE = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))


def test_near_duplicates_by_row(spark):
    rows = [(None, BASE), (None, BASE + " end"), (None, OTHER), (None, ""), (None, ""), (5, "one text of five"), (5, "quite another text of the same five"), (5, "one text of five"), (7, OTHER + " z"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    assert len([t for i, t in kept if t.startswith("word0 ")]) == 1
    assert [(i, t) for i, t in kept if t.startswith("other0 ")] == [(7, OTHER + " z")]
    assert sorted(t for i, t in kept if i == 5) == ["one text of five", "quite another text of the same five"]
    assert sorted(str(i) for i, t in kept if t == "") == ["8", "None", "None"]


def test_leaks_by_row(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # the same five words of the item at the same place, but nothing else of it
    failing = [" ".join(f"item{i}" if i < 8 else f"no{k}x{i}" for i in range(20)) for k in range(8)]
    rows = [(i, t) for i in (None, 3) for t in [*failing, item, "clean text here"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    kept = sorted(tuple(r) for r in corpus_pipeline.keep_unleaked(spark, docs, str(tmp_path)).fillna(-1).collect())
    assert kept == sorted((-1 if i is None else i, t) for i, t in rows if t != item)


# 10 --------------------------------------------------------------- near duplicates
def test_classes_of_an_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(100)]
    crowd = [(k, " ".join([*words[:99], f"last{k}"])) for k in range(12)]
    # another text of id 3 that nobody else has, longer than the one in the crowd
    rows = [*crowd, (3, " ".join(f"own{i}" for i in range(200))), (50, " ".join(f"far{i}" for i in range(200))), (None, crowd[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.class_size) for r in neardup.classes(spark, docs, large=3).collect())
    assert got == sorted([(-1, None, None), (50, 50, 1), *((i, 0, 13) for i, _ in crowd), (3, 0, 13)])


def test_every_similar_pair_of_the_documents_is_in_one_class(spark):
    import re
    from collections import Counter, defaultdict

    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    sets = {}
    for r in docs.collect():
        w = re.findall("[0-9a-z_\x80-\U0010ffff]+", (r.text or "").lower())
        sets[r.doc_id] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    holders = defaultdict(list)
    for i, s in sets.items():
        for shingle in s:
            holders[shingle].append(i)
    met = {p for own in holders.values() for p in combinations(own, 2)}
    shared = {(i, j): sum((sets[i] & sets[j]).values()) for i, j in met}
    pairs = [(i, j) for (i, j), c in shared.items() if c >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - c)]
    of = {r.doc_id: r.class_id for r in neardup.classes(spark, docs).collect()}
    assert len(pairs) > 20 and all(of[i] == of[j] for i, j in pairs)
    root = {i: i for i in sets}
    for _ in root:
        moved = [(max(root[i], root[j]), min(root[i], root[j])) for i, j in pairs if root[i] != root[j]]
        if not moved:
            break
        for high, low in moved:
            root = {k: low if v == high else v for k, v in root.items()}
    assert of == root


# 10 ---------------------------------------------------------------- row keys
def test_rows_whose_hashes_meet_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "_hashed", lambda *c: F.pmod(F.xxhash64(*c), F.lit(3)))
    texts = [f"words that nobody else has {i} a{i} b{i} c{i} d{i} e{i}" for i in range(8)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (20, texts[5], "copy"), (None, "none of these words is here", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = neardup.one_of_each(spark, docs, null_ids=True)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(8))
    assert kept.filter("doc_id IS NULL").count() == 1 and kept.columns == docs.columns

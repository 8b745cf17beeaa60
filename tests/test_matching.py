"""Containment by grams against plain search, assignment in turn, numbers by sequence."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import containment, resolve, sequence
from tallyweave.operators import workflow as W


@pytest.mark.parametrize("keys", [(), ("doc_id",)])
def test_pairs_are_those_of_a_plain_search(spark, keys):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé漢 ") for _ in range(n))
    texts = [(rng.randrange(3), n, word(rng.randrange(12))) for n in range(60)] + [(0, 100, None), (1, 101, ""), (2, 102, "ab" * 3_000 + "é")]
    patterns = [(rng.randrange(3), n, word(rng.randrange(6))) for n in range(60)] + [(0, 100, None), (1, 101, ""), (2, 102, "babé")]
    found = containment.pairs(spark.createDataFrame(texts, "doc_id int, t int, text string"), spark.createDataFrame(patterns, "doc_id int, p int, pattern string"), keys)
    expected = [(t, p) for d, t, text in texts for e, p, pattern in patterns if (not keys or d == e) and text is not None and pattern is not None and pattern in text]
    assert sorted((r.t, r.p) for r in found.collect()) == sorted(expected)


def test_no_patterns_no_pairs(spark):
    texts = spark.createDataFrame([(1, "abc")], "t int, text string")
    assert containment.pairs(texts, spark.createDataFrame([], "p int, pattern string")).collect() == []
    assert containment.pairs(texts.filter("false"), spark.createDataFrame([(1, "a")], "p int, pattern string")).collect() == []


def test_many_queries_meet_no_nested_loop(spark):
    master = spark.range(2_000).select("id", F.concat(F.lit("Name "), F.col("id").cast("string")).alias("name"))
    queries = spark.range(100_000).select(F.concat(F.lit(" NAME "), F.col("id").cast("string")).alias("query"))
    found = resolve.substring_search(queries, master, ["name"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # a name contains the queries that its number begins with
    assert found.count() == sum(len(str(n)) for n in range(2_000))
    assert found.columns == ["id", "name", "query"]


def test_items_take_the_topmost_row_left_that_shows_them(spark):
    rng = random.Random(11)
    items, rows, expected = [], [], []
    for d in range(30):
        own = [f"K-{rng.randrange(1, 14)}" for _ in range(rng.randrange(6))]
        lines = [(f"r{n}", rng.randrange(5), "  ".join(rng.sample(["k-1", "K-12", "k-3 x", "K-5", "K-1 K-3"], 2))) for n in range(rng.randrange(6))]
        items += [(d, n, s) for n, s in enumerate(own)]
        rows += [(d, *x) for x in lines]
        left = sorted(lines, key=lambda x: (x[1], x[0]))
        for n, s in enumerate(own):
            hit = next((x for x in left if s.lower() in x[2].lower()), None)
            expected.append((d, n, hit and hit[0]))
            left = [x for x in left if x is not hit]
    found = W.assign_containing(spark.createDataFrame(items, "doc_id int, pos int, sku string"), spark.createDataFrame(rows, "doc_id int, row string, top int, text string"))
    assert sorted((r.doc_id, r.pos, r.row) for r in found.collect()) == sorted(expected, key=lambda x: x[:2])


def test_one_new_row_or_a_problem(spark):
    schema = "doc_id int, row int, text string"
    before = spark.createDataFrame([(1, 0, "K-1"), (2, 0, "K-1"), (3, 0, "K-1")], schema)
    after = spark.createDataFrame([(1, 0, "K-1"), (1, 1, "x K-1 y"), (2, 0, "K-1"), (2, 1, "k-1"), (2, 2, "K-12"), (3, 0, "K-1"), (3, 1, "K-2")], schema)
    wanted = spark.createDataFrame([(n, "K-1") for n in (1, 2, 3, 4)], "doc_id int, sku string")
    assert sorted(map(tuple, W.new_row_with(before, after, wanted).collect())) == [(1, 1, None), (2, None, "multiple new rows"), (3, None, "no new row"), (4, None, "no new row")]


def test_numbers_run_on_over_all_parts(spark):
    rows = spark.range(5_000).select(F.pmod(F.xxhash64("id"), F.lit(977)).alias("k"), "id").repartition(7)
    found = sequence.numbered(rows, ["k", "id"], "n", 10)
    assert [r.n for r in found.orderBy("k", "id").collect()] == list(range(10, 5_010))
    assert sequence.numbered(rows.filter("false"), ["k"], "n").count() == 0

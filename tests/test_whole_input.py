"""Queries over all of their input: nothing is left out by an id or by what a text looks like."""

import json
from collections import defaultdict

import duckdb

from tallyweave.operators import resolve
from tallyweave.plans import extras, streams
from tallyweave.sources import tables as S

SF = "/root/testdata/sf0.001"


def test_order_json_has_every_order(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    totals = "SELECT doc_id, CAST(sum(net) AS DECIMAL(18,2)), CAST(sum(line_vat) AS DECIMAL(18,2)), CAST(sum(net) + sum(line_vat) AS DECIMAL(18,2)), count(*) FROM lines GROUP BY doc_id"
    want = sorted(con.execute(S.oracle(totals, "lines")).fetchall())
    rows = streams.q_order_json(spark, SF).select("doc_id", "total_net", "total_vat", "total_gross", "n_items").collect()
    assert sorted(map(tuple, rows)) == want and want[-1][0] >= 200


def test_prompt_payload_has_every_span(spark):
    want = defaultdict(list)
    for r in S.spans(spark, SF).orderBy("doc_id", "reading_order").collect():
        want[r.doc_id].append([r.id, r.text, round(0.5 + r.reading_order % 50 / 100, 3), [r.x0, r.y0, r.x1, r.y1], r.page])
    got = {r.doc_id: json.loads(r.payload)["spans"] for r in extras.q_prompt_payload(spark, SF).collect()}
    assert got == {i: rows if i % 2 == 0 else [x[:4] for x in rows] for i, rows in want.items()}


def test_substring_search_asks_every_query(spark):
    master = spark.createDataFrame([(k, f"Name <{k}>") for k in range(1500)], "id long, name string")
    queries = spark.createDataFrame([(f" NAME <{k}>",) for k in range(1500)] + [("nobody",)], "query string")
    found = resolve.substring_search(queries, master, ["name"]).select("query", "id").collect()
    assert sorted((r.id, r.query) for r in found) == [(k, f" NAME <{k}>") for k in range(1500)]


def test_unicode_keys_of_every_document(spark):
    import hashlib
    import unicodedata

    from tallyweave.plans import workflow

    texts = {r.doc_id: r.text for r in S.table(spark, SF, "documents").select("doc_id", "text").collect()}
    key = lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    got = {r.doc_id: r.key for r in workflow.q_normalize_unicode(spark, SF).collect()}
    assert got == {i: hashlib.sha256(key(t or "").encode()).hexdigest() for i, t in texts.items()}

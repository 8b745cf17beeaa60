"""Claims out of answers of any form, and what refuses them."""

import json

import pytest

from tallyweave.sources import answers as A

CLAIM = {"path": "currency", "value": "EUR", "evidence_ids": ["a", "b"], "ambiguity": None}


def whole(**changes):
    return {"item_count": 1, "delivery_address_present": False, "claims": [CLAIM], **changes}


def claim(**changes):
    return json.dumps(whole(claims=[CLAIM, CLAIM | changes]))


CASES = {
    "plain": json.dumps(whole()),
    "fenced": "Sure.\n```json\n" + json.dumps(whole(item_count="2")) + "\n```",
    "bare fence": "```\n" + json.dumps(whole()) + "\n```",
    "inside": "I saw {this}, so " + json.dumps(whole()) + ' and {"more": 1}',
    "numbers": json.dumps(whole(item_count=3.0, delivery_address_present=1)),
    "words": json.dumps(whole(item_count=" 4 ", delivery_address_present="OFF")),
    "yes": json.dumps(whole(item_count=True, delivery_address_present="y")),
    "empty": json.dumps(whole(claims=[], item_count=0)),
    "null value": claim(value=None, evidence_ids=[]),
    "long": json.dumps(whole(claims=[CLAIM | {"value": "x" * 200_000}])),
    "nothing": None,
    "blank": "  ",
    "words only": "there is {none}",
    "list": "[{}]",
    "text": '"x"',
    "fraction": json.dumps(whole(item_count=1.5)),
    "below": json.dumps(whole(item_count=-1)),
    "above": json.dumps(whole(item_count=101)),
    "not a number": json.dumps(whole(item_count="two", delivery_address_present="maybe")),
    "no number": json.dumps(whole(item_count=None, delivery_address_present=None)),
    "fields": json.dumps({"item_count": 1, "claims": [], "note": 1}),
    "claims": json.dumps(whole(claims={"path": "x"})),
    "claim": json.dumps(whole(claims=["x", CLAIM])),
    "claim fields": json.dumps(whole(claims=[{"path": "x", "value": "1", "evidence_ids": [], "page": 1}])),
    "types": claim(path=None, value=7, evidence_ids="a", ambiguity=["x"]),
    "ids": claim(evidence_ids=["a", None]),
    "number ids": claim(evidence_ids=[1]),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame(list(CASES.items()), "doc_id string, answer string")
    headers, claims, refusals = A.read_answers(rows.withColumn("path", rows.doc_id))
    out = {doc: [None, [], []] for doc in CASES}
    for r in headers.collect():
        out[r.doc_id][0] = (r.item_count, r.delivery)
    for r in claims.orderBy("doc_id", "ord").collect():
        out[r.doc_id][1].append((r.path, r.value, list(r.evidence_ids), r.ambiguity))
    for r in refusals.collect():
        out[r.doc_id][2].append((r.path, r.code))
    return {doc: (h, c, sorted(f)) for doc, (h, c, f) in out.items()}


ONE = [("currency", "EUR", ["a", "b"], None)]


@pytest.mark.parametrize(("doc", "header"), [("plain", (1, False)), ("fenced", (2, False)), ("bare fence", (1, False)), ("inside", (1, False)), ("numbers", (3, True)), ("words", (4, False)), ("yes", (1, True))])
def test_forms_of_an_answer(read, doc, header):
    assert read[doc] == (header, ONE, [])


def test_empty_values_and_long_ones(read):
    assert read["empty"] == ((0, False), [], [])
    assert read["null value"][1] == [*ONE, ("currency", None, [], None)]
    assert len(read["long"][1][0][1]) == 200_000


@pytest.mark.parametrize("doc", ["nothing", "blank", "words only", "list", "text"])
def test_answers_without_an_object(read, doc):
    assert read[doc] == (None, [], [("", "NO_JSON_OBJECT")])


@pytest.mark.parametrize(
    ("doc", "faults"),
    [
        ("fraction", [("item_count", "INVALID_FIELD")]), ("below", [("item_count", "INVALID_FIELD")]), ("above", [("item_count", "INVALID_FIELD")]),
        ("not a number", [("delivery_address_present", "INVALID_FIELD"), ("item_count", "INVALID_FIELD")]), ("no number", [("delivery_address_present", "INVALID_FIELD"), ("item_count", "INVALID_FIELD")]),
        ("fields", [("delivery_address_present", "MISSING_FIELD"), ("note", "UNEXPECTED_FIELD")]), ("claims", [("claims", "INVALID_FIELD")]), ("claim", [("claims[0]", "INVALID_FIELD")]),
        ("claim fields", [("claims[0].ambiguity", "MISSING_FIELD"), ("claims[0].page", "UNEXPECTED_FIELD")]),
        ("types", [(f"claims[1].{f}", "INVALID_FIELD") for f in ("ambiguity", "evidence_ids", "path", "value")]),
        ("ids", [("claims[1].evidence_ids", "INVALID_FIELD")]), ("number ids", [("claims[1].evidence_ids", "INVALID_FIELD")]),
    ],
)
def test_faults_refuse_the_whole_answer(read, doc, faults):
    assert read[doc] == (None, [], faults)


def test_no_answers(spark):
    assert [df.count() for df in A.read_answers(spark.createDataFrame([], "doc_id string, answer string"))] == [0, 0, 0]

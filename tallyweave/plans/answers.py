"""Queries: claims out of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import answers as A
from ..sources import tables as S
from ..sources.tables import oracle


def _answers(spark, sf):
    """One answer per order: fenced, inside other text, plain, with words for numbers, or with one of seven faults."""
    k, fault = F.col("doc_id"), F.when(F.col("doc_id") % 5 == 4, F.floor(F.col("doc_id") / 5) % 7)
    item = S.items(spark, sf).select("doc_id", "pos", "sku")
    path = F.concat(F.lit("items["), F.col("pos").cast("string"), F.lit("].sku"))
    ids = F.when(F.col("pos") % 3 != 2, F.array(F.concat(F.lit("e"), F.col("pos").cast("string")))).otherwise(F.array().cast("array<string>"))
    claim = F.struct(path.alias("path"), F.when(F.col("pos") % 4 != 3, F.col("sku")).alias("value"), ids.alias("evidence_ids"), F.when(F.col("pos") % 4 == 3, "un{clear").alias("ambiguity"))
    docs = item.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", claim.alias("c")))), lambda x: x["c"]).alias("claims"))
    text = F.to_json("claims", {"ignoreNullFields": "false"})
    text = F.when(fault == 4, F.regexp_replace(text, '^(.*?"value":)"[^"]*"', "$17")).otherwise(text)
    count = F.when(fault == 0, "101").when(k % 5 == 3, F.concat(F.lit('" '), F.size("claims").cast("string"), F.lit('"'))).otherwise(F.size("claims").cast("string"))
    flag = F.when(k % 5 == 3, '"Yes"').when(k % 2 == 0, "true").otherwise("0")
    body = F.concat(
        F.lit('{"item_count":'), count, F.when(fault == 3, "").otherwise(F.concat(F.lit(',"delivery_address_present":'), flag)),
        F.lit(',"claims":'), F.when(fault == 1, "{}").otherwise(text), F.when(fault == 2, ',"note":null').otherwise(""), F.lit("}"),
    )
    told = (
        F.when(fault == 5, "no {answer} here").when(fault == 6, "[1, 2]")
        .when(k % 5 == 0, F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(k % 5 == 1, F.concat(F.lit("Here {it} is: "), body, F.lit(" {done}")))
        .otherwise(body)
    )
    return docs.select("doc_id", told.alias("answer"))


def q_answer_claims(spark, sf):
    return A.read_answers(_answers(spark, sf))[1].withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def q_answer_headers(spark, sf):
    return A.read_answers(_answers(spark, sf))[0]


def q_answer_refusals(spark, sf):
    return A.read_answers(_answers(spark, sf))[2]


QUERIES = {"q_answer_claims": q_answer_claims, "q_answer_headers": q_answer_headers, "q_answer_refusals": q_answer_refusals}

ORACLES = {
    "q_answer_claims": oracle(
        """SELECT doc_id, pos AS ord, concat('items[', pos, '].sku') AS path, CASE WHEN pos % 4 <> 3 THEN sku END AS value, CASE WHEN pos % 3 <> 2 THEN concat('e', pos) ELSE '' END AS evidence_ids, CASE WHEN pos % 4 = 3 THEN 'un{clear' END AS ambiguity
FROM items WHERE doc_id % 5 <> 4""",
        "items",
    ),
    "q_answer_headers": oracle("SELECT doc_id, CAST(count(*) AS INTEGER) AS item_count, doc_id % 5 = 3 OR doc_id % 2 = 0 AS delivery FROM items WHERE doc_id % 5 <> 4 GROUP BY doc_id", "items"),
    "q_answer_refusals": oracle(
        """SELECT doc_id, ['item_count', 'claims', 'note', 'delivery_address_present', 'claims[0].value', '', ''][doc_id // 5 % 7 + 1] AS path, ['INVALID_FIELD', 'INVALID_FIELD', 'UNEXPECTED_FIELD', 'MISSING_FIELD', 'INVALID_FIELD', 'NO_JSON_OBJECT', 'NO_JSON_OBJECT'][doc_id // 5 % 7 + 1] AS code
FROM (SELECT DISTINCT doc_id FROM items) WHERE doc_id % 5 = 4""",
        "items",
    ),
}

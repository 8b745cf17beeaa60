"""Claims out of a model's answers: headers, claim rows, and refusals of answers that do not have the agreed form.

An answer is one JSON object with the fields of ANSWER, each claim one with the fields of CLAIM; none may lack and no other may
be there. It is parsed as a VARIANT, in a fenced block, as the whole text, or as the first object inside other text; only the last
needs Python. An answer with one fault is refused whole, with every fault named; nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import staged
from .documents import _embedded_object

#: The fields of an answer and of a claim, and how yes and no may be written.
ANSWER = ("item_count", "delivery_address_present", "claims")
CLAIM = ("path", "value", "evidence_ids", "ambiguity")
YES, NO = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")
MOST_ITEMS = 100


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, VOID and so on."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z_]+", 0)


def whole_number(v: Column) -> Column:
    """A number without fraction, or text of digits; else null."""
    kind = _kind(v)
    number = _get(v, "$", "decimal(38,10)")
    text = F.trim(_get(v, "$", "string"))
    return F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), F.when(number == F.floor(number), number.try_cast("long"))).when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))).when(kind == "BOOLEAN", _get(v, "$", "boolean").cast("long"))


def yes_or_no(v: Column) -> Column:
    """True or false as such, as 1 or 0, or as a word; else null."""
    kind, number, word = _kind(v), _get(v, "$", "decimal(38,10)"), F.lower(_get(v, "$", "string"))
    return F.when(kind == "BOOLEAN", _get(v, "$", "boolean")).when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), F.when(number == 1, True).when(number == 0, False)).when(kind == "STRING", F.when(word.isin(*YES), True).when(word.isin(*NO), False))


def parsed(answers: DataFrame) -> DataFrame:
    """(doc_id, v): the JSON value of each answer (doc_id, answer), null if there is none."""
    fenced = F.regexp_extract(F.trim("answer"), r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.trim("answer"))
    direct = answers.select("doc_id", body.alias("body")).withColumn("v", F.try_parse_json("body"))
    inside = _embedded_object(F.when(F.col("v").isNull(), F.col("body")))
    return direct.select("doc_id", F.coalesce("v", F.try_parse_json(inside)).alias("v"))


def read_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, claims, refusals) of (doc_id, answer).

    Headers: doc_id, item_count, delivery. Claims: doc_id, ord, path, value, evidence_ids, ambiguity. Refusals: doc_id, path, code. A null
    answer is refused. Documents are told apart by doc_id, which has to be their key.
    """
    fields = staged(parsed(answers), "answers").withColumn("f", _get(F.col("v"), "$", "map<string,variant>"))
    of = lambda name: F.try_element_at("f", F.lit(name))
    heads = fields.select(
        "doc_id", F.col("f").isNotNull().alias("object"), F.map_keys("f").alias("names"), whole_number(of("item_count")).alias("item_count"), yes_or_no(of("delivery_address_present")).alias("delivery"), _get(of("claims"), "$", "array<variant>").alias("claims")
    )
    texts = lambda names: F.array(*map(F.lit, names))
    fault = lambda path, code: F.struct(path.alias("path"), F.lit(code).alias("code"))
    there = lambda name: F.array_contains("names", name)
    lack = lambda want, prefix: F.transform(F.array_except(texts(want), "names"), lambda n: fault(F.concat(prefix, n), "MISSING_FIELD"))
    more = lambda want, prefix: F.transform(F.array_except("names", texts(want)), lambda n: fault(F.concat(prefix, n), "UNEXPECTED_FIELD"))
    wrong = lambda when, path: F.when(when, fault(path, "INVALID_FIELD"))
    bad_count = there("item_count") & (F.col("item_count").isNull() | (F.col("item_count") < 0) | (F.col("item_count") > MOST_ITEMS))
    own = F.array_compact(F.array(wrong(bad_count, F.lit("item_count")), wrong(there("delivery_address_present") & F.col("delivery").isNull(), F.lit("delivery_address_present")), wrong(there("claims") & F.col("claims").isNull(), F.lit("claims"))))
    of_head = F.when(~F.col("object"), F.array(fault(F.lit(""), "NO_JSON_OBJECT"))).otherwise(F.concat(lack(ANSWER, F.lit("")), more(ANSWER, F.lit("")), own))
    refused = heads.select("doc_id", F.explode(of_head).alias("x")).select("doc_id", "x.*")

    rows = heads.select("doc_id", F.posexplode("claims").alias("ord", "c"))
    rows = rows.select("doc_id", "ord", _get(F.col("c"), "$", "map<string,variant>").alias("f")).withColumn("names", F.map_keys("f"))
    rows = rows.select("doc_id", "ord", F.col("f").isNotNull().alias("object"), "names", *(_kind(of(n)).alias(f"{n}_kind") for n in CLAIM), _get(of("path"), "$", "string").alias("path"), _get(of("value"), "$", "string").alias("value"), _get(of("evidence_ids"), "$", "array<variant>").alias("ids"), _get(of("ambiguity"), "$", "string").alias("ambiguity"))
    rows = staged(rows.withColumns({"kinds": F.transform("ids", lambda x: F.schema_of_variant(x)), "evidence_ids": F.transform("ids", lambda x: F.try_variant_get(x, "$", "string"))}).drop("ids"), "claims")
    at = F.concat(F.lit("claims["), F.col("ord").cast("string"), F.lit("]"))
    inner = F.concat(at, F.lit("."))
    text_or_none = lambda n: there(n) & ~F.col(f"{n}_kind").isin("STRING", "VOID")
    bad_ids = there("evidence_ids") & (F.col("kinds").isNull() | F.exists("kinds", lambda k: k != "STRING"))
    own = F.array_compact(F.array(wrong(there("path") & (F.col("path_kind") != "STRING"), F.concat(inner, F.lit("path"))), wrong(text_or_none("value"), F.concat(inner, F.lit("value"))), wrong(F.coalesce(bad_ids, F.lit(False)), F.concat(inner, F.lit("evidence_ids"))), wrong(text_or_none("ambiguity"), F.concat(inner, F.lit("ambiguity")))))
    of_claim = F.when(~F.col("object"), F.array(fault(at, "INVALID_FIELD"))).otherwise(F.concat(lack(CLAIM, inner), more(CLAIM, inner), own))
    refused = refused.unionByName(rows.select("doc_id", F.explode(of_claim).alias("x")).select("doc_id", "x.*"))
    refused = staged(refused, "refusals")
    gone = refused.select("doc_id").distinct()
    headers = heads.join(gone, "doc_id", "left_anti").select("doc_id", F.col("item_count").cast("int").alias("item_count"), "delivery")
    claims = rows.join(gone, "doc_id", "left_anti").select("doc_id", "ord", "path", "value", "evidence_ids", "ambiguity")
    return headers, claims, refused

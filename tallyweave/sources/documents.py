"""Readers of order records, alias profiles, recognised regions and model answers; explicit schemas only."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ADDRESS = "struct<street:string,zip:string,city:string,country:string,email:string,telephone:string,additional_name:string,address_specification:string,district:string>"
_EVIDENCE = "struct<source_text:string,confidence:double,bounding_box:array<int>,evidence_ids:array<string>,page:int>"
#: Order records as written: numbers and dates are text, and are converted on reading.
ORDER = (
    "order_date string, external_reference string, currency string, "
    f"debtor struct<company:string,first_name:string,last_name:string,alias:string,salutation:string,billing_address:{_ADDRESS},delivery_address:{_ADDRESS}>, "
    "payment struct<method:string,status:string,payment_date:string>, "
    "items array<struct<sku:string,description:string,quantity:string,unit_net_price:string,vat_percent:string,discount_percent:string,source_total:string>>, "
    "totals struct<total_net:string,total_vat:string,total_gross:string>, "
    f"evidence map<string,{_EVIDENCE}>, corrupt string"
)


def decimal(c: Column, kind: str = "decimal(14,4)") -> Column:
    """A number in a record: a comma is a point here, unlike in printed text."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast(kind)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """One row per order file; doc_id is its name. Unreadable files keep their text in `corrupt`."""
    raw = spark.read.schema(ORDER).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    item = lambda x: F.struct(F.trim(x["sku"]).alias("sku"), F.trim(x["description"]).alias("description"), *(decimal(x[n], t).alias(n) for n, t in (("quantity", "decimal(14,4)"), ("unit_net_price", "decimal(14,4)"), ("vat_percent", "decimal(7,4)"), ("discount_percent", "decimal(7,4)"), ("source_total", "decimal(14,4)"))))
    return raw.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("doc_id"),
        F.try_to_date("order_date", "yyyy-MM-dd").alias("order_date"),
        F.trim("external_reference").alias("external_reference"),
        F.upper(F.trim(F.coalesce("currency", F.lit("EUR")))).alias("currency"),
        "debtor",
        F.struct(F.trim("payment.method").alias("method"), F.upper(F.trim("payment.status")).alias("status"), F.try_to_date("payment.payment_date", "yyyy-MM-dd").alias("payment_date")).alias("payment"),
        F.transform("items", item).alias("items"),
        F.struct(*(decimal(F.col(f"totals.{n}")).alias(n) for n in ("total_net", "total_vat", "total_gross"))).alias("totals"),
        "evidence",
        "corrupt",
    )


def order_lines(orders: DataFrame) -> DataFrame:
    """Items of orders as rows with recomputed amounts."""
    from ..functions import numbers as N

    rows = orders.select("doc_id", F.posexplode("items").alias("pos", "i")).select("doc_id", "pos", "i.*")
    priced = rows.withColumn("net", N.line_net(F.col("quantity"), F.col("unit_net_price"), F.col("discount_percent")))
    return priced.withColumn("line_vat", N.line_vat(F.col("net"), F.col("vat_percent"))).withColumn("source_total", F.col("source_total").cast("decimal(18,2)"))


def schema_issues(orders: DataFrame) -> DataFrame:
    """What a record lacks or has out of range: doc_id, code, path, message, severity."""
    percent = lambda c: c.isNull() | (c < 0) | (c > 100)
    checks = [
        (F.col("corrupt").isNotNull(), "order"), (F.col("order_date").isNull(), "order_date"), (F.coalesce(F.length("external_reference"), F.lit(0)) == 0, "external_reference"),
        (F.length("currency") != 3, "currency"), (F.coalesce(F.size("items"), F.lit(0)) <= 0, "items"),
        (F.coalesce("debtor.company", "debtor.first_name", "debtor.last_name").isNull(), "debtor"),
        *((F.coalesce(F.length(F.trim(f"debtor.billing_address.{f}")), F.lit(0)) == 0, f"debtor.billing_address.{f}") for f in ("street", "zip", "city", "country")),
        *((F.col(f"totals.{f}").isNull(), f"totals.{f}") for f in ("total_net", "total_vat", "total_gross")),
        (F.exists("items", lambda i: i["quantity"].isNull() | (i["quantity"] <= 0)), "items.quantity"),
        (F.exists("items", lambda i: percent(i["vat_percent"]) | percent(i["discount_percent"])), "items.percent"),
    ]
    paths = F.array_compact(F.array(*(F.when(bad, path) for bad, path in checks)))
    return orders.select("doc_id", F.explode(paths).alias("path")).select("doc_id", F.lit("INVALID_EXTRACTED_VALUE").alias("code"), "path", F.lit("invalid value").alias("message"), F.lit("error").alias("severity"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Names by group and key of a profile: (group, key, name)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("group", "body"))
    keyed = raw.select("group", F.from_json("body", "map<string,string>").alias("m")).filter("m IS NOT NULL").select("group", F.explode("m").alias("key", "names"))
    return keyed.select("group", "key", F.explode(F.coalesce(F.from_json("names", "array<string>"), F.array("names"))).alias("name"))


def required_names(aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """Names of required keys (group, key); a key without names raises when it is read."""
    lists = aliases.groupBy("group", "key").agg(F.collect_list("name").alias("names"))
    found = keys.join(lists, ["group", "key"], "left")
    return found.withColumn("names", F.when(F.col("names").isNull(), F.raise_error(F.concat(F.lit("profile lacks "), F.col("group"), F.lit("."), F.col("key")))).otherwise(F.col("names")))


def regions(blocks: DataFrame) -> DataFrame:
    """Layout blocks of (doc_id, block as JSON text): alternative key names, boxes of four numbers only."""
    b = lambda *names: F.coalesce(*(F.get_json_object("block", f"$.{n}") for n in names))
    box = F.from_json(b("block_bbox", "coordinate", "bbox"), "array<double>")
    rows = blocks.select("doc_id", F.coalesce(b("block_label", "label", "type"), F.lit("unknown")).alias("kind"), F.coalesce(b("block_content", "content", "text"), F.lit("")).alias("text"), box.alias("box"))
    return rows.filter(F.size("box") == 4).withColumn("box", F.transform("box", lambda x: F.bround(x).cast("int")))


@F.pandas_udf(StringType())
def _embedded_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def first(text):
        at = -1 if text is None else text.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                value = None
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False, sort_keys=True)
            at = text.find("{", at + 1)
        return None

    return texts.map(first)


def answer_object(c: Column) -> Column:
    """The JSON object of a model's answer: a fenced block's, else the first object in the text; null if there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return _embedded_object(F.when(fenced != "", fenced).otherwise(c))


def optional_bool(c: Column) -> Column:
    """Yes, no or unset."""
    text = F.lower(F.trim(c))
    return F.when(text.isin("1", "true", "yes", "on"), True).when(text.isin("0", "false", "no", "off"), False)

"""What goes out to people and models: compact payloads, error paths, grids and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.resolve import addresses_match
from .extraction import staged


def prompt_payload(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans of a document as positional rows in reading order; the page is left out where there is only one. (doc_id, payload)"""
    sizes = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.array("page", "width", "height"))).alias("pages"))
    one = F.struct("reading_order", "id", "text", F.round("confidence", 3).alias("confidence"), "x0", "y0", "x1", "y1", "page")
    return payload_rows(spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("spans")).join(sizes.hint("merge"), "doc_id"))


#: Fixed value: text that stands in JSON as it is.
AS_IT_IS = r"^[ !#-\[\]-~]*\z"


def payload_rows(rows: DataFrame) -> DataFrame:
    """`prompt_payload` of documents in one row each: doc_id, spans in reading order (confidences rounded), pages as arrays of page, width, height."""
    several = F.size("pages") > 1
    quoted = lambda c: F.when(c.rlike(AS_IT_IS), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))
    # a row as JSON text: columns of a positional row differ in type
    text = lambda x: F.concat(F.lit("["), F.concat_ws(",", quoted(x["id"]), quoted(x["text"]), x["confidence"].cast("string"), F.to_json(F.array(x["x0"], x["y0"], x["x1"], x["y1"])), F.when(several, x["page"].cast("string"))), F.lit("]"))
    names = F.when(several, '["id","text","confidence","bbox","page"]').otherwise('["id","text","confidence","bbox"]')
    body = F.concat(F.lit('{"pages":'), F.to_json("pages"), F.lit(',"page_columns":["page","width","height"],"span_columns":'), names, F.lit(',"spans":['), F.array_join(F.transform("spans", text), ","), F.lit("]}"))
    return rows.select("doc_id", body.alias("payload"))


def document_text(spans: DataFrame) -> DataFrame:
    """All lines of a document, one below the other."""
    lines = F.array_sort(F.collect_list(F.struct("reading_order", "text")))
    return spans.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def error_path(parts: Column) -> Column:
    """('items', '0', 'sku') as items[0].sku."""
    step = lambda path, x: F.when(x.rlike("^[0-9]+$"), F.concat(path, F.lit("["), x, F.lit("]"))).when(path == "", x).otherwise(F.concat(path, F.lit("."), x))
    return F.aggregate(parts, F.lit(""), step)


def delivery(orders: DataFrame) -> DataFrame:
    """orders with structs billing and delivery (street, zip, city, country): adds whether delivery is distinct, the effective address, and the one to store."""
    distinct = F.col("delivery").isNotNull() & ~addresses_match("delivery", "billing", unicode=False)
    return orders.withColumn("distinct_delivery", F.coalesce(distinct, F.lit(False))).withColumn("effective", F.coalesce("delivery", "billing")).withColumn("stored_delivery", F.when(~F.col("distinct_delivery"), F.col("delivery")))


def lacking(row: Column, expected: Column) -> Column:
    """The expected texts that a grid row shows neither as text nor by digits alone."""
    shown, digits = T.normalize_text(row, False), lambda c: F.regexp_replace(c, r"[^0-9,.\-]", "")

    def shows(v: Column) -> Column:
        key = T.normalize_text(v, False)
        return shown.contains(key) | ((digits(key) != "") & digits(shown).contains(digits(key)))

    return F.filter(expected, lambda v: ~shows(v))


def text_matches(expected: Column, observed: Column) -> Column:
    """Loose match of diagnostic output: long numbers stand alone, short or numeric text is equal, other text is part of the other."""
    numeric = lambda c: F.replace(c, F.lit("."), F.lit("")).rlike("^[0-9]+$")
    alone = F.regexp_like(observed, F.concat(F.lit(r"(?<![0-9])"), expected, F.lit(r"(?![0-9])")))
    short = (F.length(expected) < 4) | (F.length(observed) < 4) | numeric(expected) | numeric(observed)
    return F.when(observed == "", False).when(expected.rlike("^[0-9]{4,}$"), alone).when(short, expected == observed).otherwise(observed.contains(expected) | expected.contains(observed))


def visible_rows(controls: DataFrame) -> DataFrame:
    """Data rows of a grid (doc_id, kind, visible, enabled, …); where there are none, its custom rows."""
    seen = controls.filter("visible AND enabled AND kind IN ('DataItem', 'Custom')")
    data = seen.filter("kind = 'DataItem'")
    return data.unionByName(seen.filter("kind = 'Custom'").join(data.select("doc_id").distinct(), "doc_id", "left_anti"))


def depths(tree: DataFrame, limit: int = 30) -> DataFrame:
    """Depth of each node of (node, parent), roots at 0, down to a limit; nodes below no root have none.

    Every node holds a step to an ancestor and takes over that one's step, so that steps double in each round: the rounds grow
    with the logarithm of the limit, each is one join of written tables, and no table is larger than the tree.
    """
    root = F.col("parent").isNull()
    steps = tree.select("node", F.when(~root, F.col("parent")).alias("up"), F.when(root, 0).otherwise(1).alias("depth"))
    for _ in range(limit.bit_length()):
        steps = staged(steps, "depths")
        far = steps.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more")).hint("merge")
        on = steps.filter("up IS NOT NULL").join(far, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        steps = steps.filter("up IS NULL").unionByName(on)
    return steps.filter((F.col("up").isNull()) & (F.col("depth") <= limit)).select("node", "depth")

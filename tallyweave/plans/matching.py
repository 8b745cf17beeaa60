"""Queries: containment, and numbers by sequence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..operators import workflow as W
from ..sources import tables as S
from ..sources.tables import oracle

TODAY = "2026-01-15"


def q_substring_many(spark, sf):
    """Ends of all customers' names, short ones and a blank one, each against all customers."""
    c = S.table(spark, sf, "customer").select("c_custkey", "c_name")
    ends = F.explode(F.array(F.upper(F.right("c_name", F.lit(4))), F.right("c_name", F.lit(2)), F.concat(F.lit("#0000"), F.right("c_name", F.lit(5)), F.lit(" ")), F.lit("  "))).alias("query")
    return R.substring_search(c.select(ends), c, ["c_name"]).select("query", "c_custkey")


def _rows(spark, sf):
    """Items of orders, and table rows that show an item's SKU and the next one's; some rows are missing, the order is reversed."""
    items = S.items(spark, sf).select("doc_id", "pos", "sku")
    after = F.lead("sku").over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = items.withColumn("next", after).filter("pos % 5 <> 3")
    return items, rows.select("doc_id", F.col("pos").alias("row"), (100 - F.col("pos")).alias("top"), F.concat_ws("  ", F.lower("sku"), "next").alias("text"))


def q_contained_assign(spark, sf):
    return W.assign_containing(*_rows(spark, sf)).select("doc_id", "pos", "sku", "row")


def q_new_row_with(spark, sf):
    items, rows = _rows(spark, sf)
    return W.new_row_with(rows.filter("row % 3 <> 1"), rows, items.filter("pos = 1").select("doc_id", "sku"))


def q_created_rows(spark, sf):
    """New product records, each with its number."""
    wanted = S.items(spark, sf).select(F.col("sku"))
    have = S.table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"))
    return R.created(wanted, have, "sku", "product")


def q_document_numbers(spark, sf):
    """Orders and invoices numbered by date."""
    orders = S.orders(spark, sf).withColumn("total_gross", F.lit("1.00").cast("decimal(18,2)"))
    return W.documents_in_order(orders, ["order_date", "doc_id"], TODAY).select("doc_id", "document_type", "number")


QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}

_ROWS = """, r AS MATERIALIZED (
  SELECT a.doc_id, a.pos AS row, 100 - a.pos AS top, lower(concat_ws('  ', a.sku, b.sku)) AS text FROM items a LEFT JOIN items b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.pos % 5 <> 3)"""

ORACLES = {
    "q_substring_many": """WITH q AS (SELECT DISTINCT unnest([upper(right(c_name, 4)), right(c_name, 2), concat('#0000', right(c_name, 5), ' '), '  ']) AS query FROM customer)
SELECT query, c_custkey FROM q JOIN customer ON contains(lower(c_name), lower(trim(query)))""",
    # items of one document in turn, with the rows that are taken already
    "q_contained_assign": "WITH RECURSIVE "
    + oracle(
        _ROWS
        + """, i AS MATERIALIZED (
  SELECT i.doc_id, i.pos, i.sku, coalesce(list(r.row ORDER BY r.top, r.row) FILTER (WHERE r.row IS NOT NULL), []) AS cands
  FROM items i LEFT JOIN r ON i.doc_id = r.doc_id AND contains(regexp_replace(r.text, '\\s+', ' ', 'g'), lower(i.sku)) GROUP BY ALL),
m AS (
  SELECT doc_id, pos, sku, cands[1] AS row, cands[1:1] AS used FROM i WHERE pos = 0
  UNION ALL
  SELECT doc_id, pos, sku, free[1], list_concat(used, free[1:1]) FROM (SELECT i.doc_id, i.pos, i.sku, m.used, list_filter(i.cands, lambda x: NOT list_contains(m.used, x)) AS free FROM m JOIN i ON i.doc_id = m.doc_id AND i.pos = m.pos + 1)
)
SELECT doc_id, pos, sku, row FROM m""",
        "items",
    ).removeprefix("WITH "),
    "q_new_row_with": oracle(
        _ROWS
        + """ SELECT i.doc_id, CASE WHEN count(r.row) = 1 THEN min(r.row) END AS row, CASE WHEN count(r.row) > 1 THEN 'multiple new rows' WHEN count(r.row) = 0 THEN 'no new row' END AS problem
FROM items i LEFT JOIN r ON i.doc_id = r.doc_id AND r.row % 3 = 1 AND contains(regexp_replace(r.text, '\\s+', ' ', 'g'), lower(i.sku)) WHERE i.pos = 1 GROUP BY i.doc_id""",
        "items",
    ),
    "q_created_rows": """WITH have AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT DISTINCT concat('SKU-', l_partkey) AS sku FROM lineitem ANTI JOIN have ON l_partkey = k)
SELECT concat('product-', (SELECT count(*) FROM have) + row_number() OVER (ORDER BY sku)) AS record_id, sku FROM new""",
    "q_document_numbers": oracle(
        """, n AS (SELECT doc_id, row_number() OVER (ORDER BY order_date, doc_id) AS k FROM hdr)
SELECT doc_id, 'Order' AS document_type, printf('ORD-%05d', 2 * k - 1) AS number FROM n UNION ALL SELECT doc_id, 'Invoice', printf('INV-%05d', 2 * k) FROM n""",
        "hdr",
    ),
}

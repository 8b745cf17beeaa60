"""Queries: claims with provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators.unique import first_of, gathered, last_of
from ..sources import tables as S
from ..sources.tables import oracle


def _ids(df):
    return df.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def q_claim_verify_priority(spark, sf):
    return C.verify(*S.claim_tables(spark, sf))


def q_claim_unknown_ids(spark, sf):
    claims, _, spans, cells = S.claim_tables(spark, sf)
    return C.with_evidence(claims, spans, cells).filter(F.size("unknown") > 0).select("doc_id", "ord", F.array_join("unknown", ",").alias("unknown"))


def q_claim_cell_mismatch(spark, sf):
    claims, _, spans, cells = S.claim_tables(spark, sf)
    return C.with_evidence(claims, spans, cells).filter("mapped > 0 AND mismatched > 0").select("doc_id", "ord", "path")


def _header_claims(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    k = F.col("doc_id")
    made = F.array(
        F.struct(F.lit(10000).alias("ord"), F.lit("order_date").alias("path"), F.when(k % 3 != 0, "2026-08-14").alias("value")),
        F.struct(F.lit(10001).alias("ord"), F.lit("payment.status").alias("path"), F.when(k % 4 == 0, "PAID").otherwise("UNPAID").alias("value")),
        F.struct(F.lit(10002).alias("ord"), F.lit("payment.payment_date").alias("path"), F.when(k % 8 == 0, "2026-08-14").alias("value")),
        F.struct(F.lit(10003).alias("ord"), F.lit("debtor.company").alias("path"), F.when(k % 5 != 0, "Acme").alias("value")),
    )
    return o.select("doc_id", F.explode(made).alias("c")).select("doc_id", "c.*")


def q_claim_missing(spark, sf):
    claims, headers, _, _ = S.claim_tables(spark, sf)
    orders = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    headers = orders.join(headers, "doc_id", "left").select("doc_id", F.coalesce("item_count", F.lit(0)).alias("item_count"), (F.col("doc_id") % 2 == 0).alias("delivery"))
    every = claims.select("doc_id", "ord", "path", "value").unionByName(_header_claims(spark, sf))
    return C.missing(every, headers, S.CLAIM_FIELDS)


def _trusted(spans, cells):
    # the cells of a document meet its spans as an array: neither side is moved
    placed = gathered(cells.filter("role = 'quantity'"), "doc_id", "placed", "id", "row")
    both = spans.join(placed, "doc_id").select("*", F.explode(F.filter("placed", lambda x: x["id"] == F.col("id"))).alias("cell")).select("doc_id", "reading_order", "id", "text", "cell.row")
    return both.select("doc_id", F.col("reading_order").alias("ord"), F.concat(F.lit("items["), F.col("row").cast("string"), F.lit("].quantity")).alias("path"), F.col("text").alias("value"), F.array("id").alias("evidence_ids"), F.lit(None).cast("string").alias("ambiguity"))


def q_claim_merge(spark, sf):
    claims, _, spans, cells = S.claim_tables(spark, sf)
    return _ids(C.merge_trusted(claims, _trusted(spans, cells))).select("doc_id", "ord", "path", "value", "evidence_ids")


def q_claim_merge_items(spark, sf):
    claims, headers, spans, cells = S.claim_tables(spark, sf)
    counts = headers.select("doc_id", F.col("item_count").alias("trusted_count"))
    return _ids(C.merge_trusted_items(claims, _trusted(spans, cells), counts)).select("doc_id", "ord", "path", "value", "evidence_ids")


def q_claim_repair(spark, sf):
    tables = S.claim_tables(spark, sf)
    claims, spans, cells = tables[0], tables[2], tables[3]
    return _ids(C.repair(claims, _trusted(spans, cells), C.verify(*tables))).select("doc_id", "ord", "path", "value", "evidence_ids")


def q_claim_sanitize(spark, sf):
    tables = S.claim_tables(spark, sf)
    issues = C.verify(*tables).select("doc_id", F.col("ord").alias("n"), "path", F.col("code").alias("note"))
    return _ids(C.sanitize(tables[0], tables[1], issues))


def q_claim_pivot(spark, sf):
    claims = S.claim_tables(spark, sf)[0]
    first = first_of(claims, ["doc_id", "path"], ["ord"])
    return C.pivot_items(first, S.CLAIM_FIELDS)


def q_claim_ground(spark, sf):
    claims, _, spans, cells = S.claim_tables(spark, sf)
    doubtful = claims.withColumn("ambiguity", F.when(F.col("ord") % 10 == 0, "unclear"))
    return C.ground(doubtful, spans, cells, F.lit(True))


def q_placeholders(spark, sf):
    o = S.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("doc_id"), F.when(k % 2 == 0, "debtor.alias").otherwise("payment.method").alias("path"), F.when(k % 3 == 0, " N/A ").when(k % 3 == 1, "--").otherwise("x").alias("value"))
    return C.without_placeholders(rows)


def q_context_window(spark, sf):
    claims, _, spans, cells = S.claim_tables(spark, sf)
    cited = spans.filter("reading_order % 9 = 4 AND doc_id % 3 <> 0").select("doc_id", "id")
    return C.repair_context(spans, cited).select("doc_id", "id")


def q_following_three(spark, sf):
    lines = S.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("reading_order"), F.when(F.col("turn") == 0, "Delivery Address").when((F.col("turn") == 2) & (F.col("conv_id") % 3 == 0), "not shipped").otherwise("Same as billing").alias("text"))
    return C.no_delivery(lines)


def q_status_doubt(spark, sf):
    o = S.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    claims = o.select(k.alias("doc_id"), F.lit(0).alias("ord"), F.lit("payment.status").alias("path"), F.lit("paid").alias("value"), F.array(F.lit("a"), F.lit("b")).alias("evidence_ids"), F.lit("two readings").alias("ambiguity"))
    spans = o.select(k.alias("doc_id"), F.explode(F.array(F.struct(F.lit("a").alias("id"), F.when(k % 3 == 0, "Paid").otherwise("Status").alias("text")), F.struct(F.lit("b").alias("id"), F.when(k % 2 == 0, "PAID").otherwise("UNPAID").alias("text")))).alias("x")).select("doc_id", "x.*")
    return C.without_proven_doubt(claims, spans).select("doc_id", "ambiguity")


def q_search_terms(spark, sf):
    claims = S.claim_tables(spark, sf)[0]
    return claims.select("path").distinct().select("path", F.array_join(C.search_terms(F.col("path")), ",").alias("terms"))


def _repeated_lines(spark, sf):
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def q_first_wins_dedupe(spark, sf):
    return first_of(_repeated_lines(spark, sf), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def q_last_wins(spark, sf):
    return last_of(_repeated_lines(spark, sf), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


QUERIES = {f.__name__: f for f in (q_claim_verify_priority, q_claim_unknown_ids, q_claim_cell_mismatch, q_claim_missing, q_claim_merge, q_claim_merge_items, q_claim_repair, q_claim_sanitize, q_claim_pivot, q_claim_ground, q_placeholders, q_context_window, q_following_three, q_status_doubt, q_search_terms, q_first_wins_dedupe, q_last_wins)}

_REQ = f"[{', '.join(repr(p) for p in C.REQUIRED_PATHS)}]"
_TRUSTED = "(SELECT doc_id, reading_order AS ord, concat('items[', row, '].quantity') AS path, text AS value, id AS evidence_ids FROM cells WHERE role = 'quantity')"
_CLAIM = "SELECT c.doc_id, c.ord, c.path, c.value, coalesce(c.eid, '') AS evidence_ids FROM claims c"

ORACLES = {
    "q_claim_verify_priority": oracle("SELECT doc_id, ord, code, path FROM checked WHERE code IS NOT NULL", "claims"),
    "q_claim_unknown_ids": oracle("SELECT doc_id, ord, eid AS unknown FROM claims WHERE eid = 'x9'", "claims"),
    "q_claim_cell_mismatch": oracle("SELECT c.doc_id, c.ord, c.path FROM claims c JOIN cells l ON c.doc_id = l.doc_id AND c.eid = l.id WHERE c.path <> concat('items[', l.row, '].', l.role)", "claims"),
    "q_claim_missing": oracle(
        f""", every AS (SELECT doc_id, ord, path, value FROM claims
  UNION ALL SELECT o_orderkey, 10000, 'order_date', CASE WHEN o_orderkey % 3 <> 0 THEN 'x' END FROM orders
  UNION ALL SELECT o_orderkey, 10001, 'payment.status', CASE WHEN o_orderkey % 4 = 0 THEN 'PAID' ELSE 'UNPAID' END FROM orders
  UNION ALL SELECT o_orderkey, 10002, 'payment.payment_date', CASE WHEN o_orderkey % 8 = 0 THEN 'x' END FROM orders
  UNION ALL SELECT o_orderkey, 10003, 'debtor.company', CASE WHEN o_orderkey % 5 <> 0 THEN 'x' END FROM orders),
given AS (SELECT doc_id, path, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY ord DESC) AS n FROM every) WHERE n = 1 AND value IS NOT NULL AND trim(value) <> ''),
required AS (SELECT o_orderkey AS doc_id, unnest({_REQ}) AS path FROM orders
  UNION ALL SELECT o_orderkey, concat('debtor.delivery_address.', unnest(['street', 'zip', 'city', 'country'])) FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT doc_id, concat('items[', pos, '].', field) FROM clong SEMI JOIN orders ON doc_id = o_orderkey)
SELECT r.doc_id, 'MISSING_REQUIRED_CLAIM' AS code, r.path FROM required r ANTI JOIN given g ON r.doc_id = g.doc_id AND r.path = g.path
UNION ALL SELECT o_orderkey, 'MISSING_IDENTITY_CLAIM', 'debtor.company' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'MISSING_ITEM_ROWS', 'item_count' FROM orders ANTI JOIN chdr ON o_orderkey = doc_id
UNION ALL SELECT o_orderkey, 'MISSING_CONDITIONAL_CLAIM', 'payment.payment_date' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0""",
        "claims",
    ),
    "q_claim_merge": oracle(f"{_CLAIM} ANTI JOIN {_TRUSTED} t ON c.doc_id = t.doc_id AND c.path = t.path UNION ALL SELECT * FROM {_TRUSTED}", "claims"),
    "q_claim_merge_items": oracle(f"{_CLAIM} ANTI JOIN {_TRUSTED} t ON c.doc_id = t.doc_id AND c.path = t.path WHERE c.path <> 'items[500].sku' UNION ALL SELECT * FROM {_TRUSTED}", "claims"),
    "q_claim_repair": oracle(
        f""", bad AS MATERIALIZED (SELECT DISTINCT doc_id, path FROM checked WHERE code IS NOT NULL)
{_CLAIM} ANTI JOIN bad i ON c.doc_id = i.doc_id AND c.path = i.path
UNION ALL SELECT t.* FROM {_TRUSTED} t SEMI JOIN bad i ON t.doc_id = i.doc_id AND t.path = i.path""",
        "claims",
    ),
    "q_claim_sanitize": oracle(
        """, notes AS (SELECT doc_id, path, string_agg(code, '; ' ORDER BY ord) AS note FROM checked WHERE code IS NOT NULL GROUP BY doc_id, path),
firsts AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY ord) = 1)
SELECT f.doc_id, f.path, CASE WHEN note IS NULL THEN value END AS value, coalesce(eid, '') AS evidence_ids, note AS ambiguity
FROM firsts f LEFT JOIN notes n ON f.doc_id = n.doc_id AND f.path = n.path WHERE f.path <> 'items[500].sku'""",
        "claims",
    ),
    "q_claim_pivot": oracle(
        """, firsts AS (SELECT *, CAST(regexp_extract(path, '[0-9]+') AS INTEGER) AS item, split_part(path, '.', 2) AS field FROM claims QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY ord) = 1)
SELECT doc_id, item, max(value) FILTER (WHERE field = 'sku') AS sku, max(value) FILTER (WHERE field = 'quantity') AS quantity, max(value) FILTER (WHERE field = 'unit_net_price') AS unit_net_price,
max(value) FILTER (WHERE field = 'source_total') AS source_total FROM firsts GROUP BY doc_id, item""",
        "claims",
    ),
    "q_claim_ground": oracle(
        """, r AS (SELECT c.*, l.text, l.row, l.role FROM claims c LEFT JOIN cells l ON c.doc_id = l.doc_id AND c.eid = l.id)
SELECT doc_id, ord, path, 'AMBIGUOUS_FIELD' AS code, CASE WHEN value IS NULL THEN 'error' ELSE 'warning' END AS severity FROM r WHERE ord % 10 = 0
UNION ALL SELECT doc_id, ord, path, 'MISSING_REQUIRED_VALUE', 'error' FROM r WHERE value IS NULL AND ord % 10 <> 0
UNION ALL SELECT doc_id, ord, path, 'MISSING_EVIDENCE', 'error' FROM r WHERE value IS NOT NULL AND eid IS NULL
UNION ALL SELECT doc_id, ord, path, 'UNKNOWN_EVIDENCE_ID', 'error' FROM r WHERE value IS NOT NULL AND eid = 'x9'
UNION ALL SELECT doc_id, ord, path, 'TABLE_CELL_MISMATCH', 'error' FROM r WHERE value IS NOT NULL AND text IS NOT NULL AND path <> concat('items[', row, '].', role)
UNION ALL SELECT doc_id, ord, path, 'UNGROUNDED_VALUE', 'error' FROM r WHERE value IS NOT NULL AND text IS NOT NULL
  AND NOT CASE WHEN path LIKE '%.sku' THEN contains(text, value) ELSE coalesce(TRY_CAST(value AS DECIMAL(18,2)) = TRY_CAST(text AS DECIMAL(18,2)), false) END""",
        "claims",
    ),
    "q_placeholders": """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'debtor.alias' ELSE 'payment.method' END AS path,
CASE WHEN o_orderkey % 3 = 2 THEN 'x' WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN ' N/A ' ELSE '--' END AS value FROM orders""",
    "q_context_window": oracle(
        """, hits AS (SELECT doc_id, reading_order FROM cells WHERE reading_order % 9 = 4 AND doc_id % 3 <> 0)
SELECT c.doc_id, c.id FROM cells c SEMI JOIN hits h ON c.doc_id = h.doc_id AND c.reading_order BETWEEN h.reading_order - 2 AND h.reading_order + 2
UNION ALL SELECT c.doc_id, c.id FROM cells c ANTI JOIN hits h ON c.doc_id = h.doc_id WHERE c.reading_order < 32""",
        "claims",
    ),
    "q_following_three": "SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE conv_id % 3 = 0 AND turn = 2 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)",
    "q_status_doubt": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'two readings' END AS ambiguity FROM orders",
    "q_search_terms": oracle("SELECT DISTINCT path, concat_ws(',', regexp_extract(path, '^items.*]'), CASE split_part(path, '.', 2) WHEN 'sku' THEN 'sku' WHEN 'quantity' THEN 'quantity' WHEN 'unit_net_price' THEN 'unit,net,price' ELSE 'source,total' END) AS terms FROM claims", "claims"),
    "q_first_wins_dedupe": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1",
    "q_last_wins": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC) = 1",
}

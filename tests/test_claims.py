"""Claims: verification, delivery markers, addresses, record files, streams."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from tallyweave.operators import claims as C
from tallyweave.operators import rules
from tallyweave.operators import workflow as W
from tallyweave.sources import documents as J
from tallyweave.streaming import states

CLAIM = "doc_id string, ord int, path string, value string, evidence_ids array<string>, ambiguity string"


def claims(spark, rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], CLAIM)


def fixture(spark):
    texts = {"a": "Issued on 03.02.2027", "b": "Payment UNPAID", "c": "2", "e": "All in EUR", "f": "Björk Öl KG"}
    spans = spark.createDataFrame([("d", k, v, i) for i, (k, v) in enumerate(texts.items())], "doc_id string, id string, text string, reading_order int")
    cells = spark.createDataFrame([("d", "c", 0, "quantity")], "doc_id string, id string, row int, role string")
    headers = spark.createDataFrame([("d", 1, False)], "doc_id string, item_count int, delivery boolean")
    return headers, spans, cells


def test_verification_takes_the_first_failure(spark):
    headers, spans, cells = fixture(spark)
    rows = claims(spark, [("order_date", "2027-02-03", ["a"], None), ("order_date", "2027-02-03", ["a"], None), ("nonsense", "x", ["a"], None), ("currency", "EUR", ["e"], None), ("payment.status", "PAID", ["b"], None), ("items[0].quantity", "2", ["c"], None), ("items[0].sku", "2", ["c"], None), ("debtor.company", "björk öl kg", ["f"], None), ("external_reference", "x", ["zz"], None), ("payment.method", "x", [], None), ("debtor.alias", None, [], None)])
    found = {r.ord: r.code for r in C.verify(rows, headers, spans, cells).collect()}
    assert found == {1: "DUPLICATE_CLAIM", 2: "UNSUPPORTED_CLAIM_PATH", 4: "UNGROUNDED_VALUE", 6: "TABLE_CELL_MISMATCH", 7: "UNGROUNDED_VALUE", 8: "UNKNOWN_EVIDENCE_ID", 9: "MISSING_EVIDENCE"}


def test_paid_is_not_proven_by_a_text_that_also_says_unpaid(spark):
    row = spark.createDataFrame([("PAID", "PAID UNPAID")], "v string, t string")
    weak = C.supported(F.lit("payment.status"), F.col("v"), F.col("t"), F.col("t"))
    strong = C.proven("status", F.col("v"), F.col("t"), F.col("t"))
    assert tuple(row.select(weak, strong).first()) == (True, False)


def test_delivery_marker(spark):
    rows = [("d", 0, "Delivery Address"), ("d", 1, "n/a"), ("f", 0, "Shipping address"), ("f", 1, "x"), ("f", 2, "y"), ("f", 3, "no shipping"), ("e", 0, "Delivery Address"), ("e", 1, "Same as billing")]
    lines = spark.createDataFrame(rows, "doc_id string, reading_order int, text string")
    assert sorted(r.doc_id for r in C.no_delivery(lines).collect()) == ["d", "f"]


def test_combined_postal_and_city(spark):
    schema = "doc_id string, zip string, city string, country string, lines array<string>"
    rows = [("a", "24103 Kiel", "Kiel", "Germany", []), ("b", "24103", "Ulm", "Germany", ["24103 Kiel"]), ("c", "24103 Kiel", None, "Germany", ["89073 Ulm"]), ("d", "x", "y", "Atlantis", [])]
    found = {r.doc_id: (r.zip, r.city, r.code) for r in C.address_parts(spark.createDataFrame(rows, schema)).collect()}
    clash = "CONFLICTING_ADDRESS_COMPONENTS"
    assert found == {"a": ("24103", "Kiel", None), "b": ("24103", "Ulm", clash), "c": ("24103 Kiel", None, clash), "d": ("x", "y", None)}


ORDER = {
    "order_date": "2027-02-03", "external_reference": "R-77", "currency": "eur",
    "debtor": {"company": "Nordlicht KG", "billing_address": {"street": "Hafenweg 9", "zip": "24103", "city": "Kiel", "country": "Germany"}},
    "payment": {"method": "Cash", "status": "OVERDUE", "payment_date": None},
    "items": [{"sku": "K-1", "description": "x", "quantity": "3", "unit_net_price": "40.00", "vat_percent": "10", "discount_percent": "5", "source_total": "114.00"}, {"sku": "K-2", "description": "y", "quantity": "1", "unit_net_price": "30,50", "vat_percent": "20", "discount_percent": "0", "source_total": "30.50"}],
    "totals": {"total_net": "144.50", "total_vat": "17.50", "total_gross": "162.00"},
}


def test_order_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(ORDER, indent=1))
    (tmp_path / "bad.json").write_text('{"order_date": ')
    orders = J.read_orders(spark, str(tmp_path)).cache()
    sums = {r.doc_id: (r.total_net, r.total_vat, r.total_gross) for r in rules.totals(J.order_lines(orders)).collect()}
    assert sums == {"good": (Decimal("144.50"), Decimal("17.50"), Decimal("162.00"))}
    assert {r.doc_id for r in J.schema_issues(orders).collect()} == {"bad"}
    assert rules.line_issues(J.order_lines(orders)).count() == 0


def test_aliases_and_regions(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"labels": {"sku": ["SKU", "Item"]}, "timeout": 3}))
    names = J.read_aliases(spark, str(tmp_path / "p.json"))
    assert sorted((r.group, r.key, r.name) for r in names.collect()) == [("labels", "sku", "Item"), ("labels", "sku", "SKU")]
    blocks = spark.createDataFrame([("d", '{"label": "table", "bbox": [1, 2, 3.5, 4]}'), ("d", '{"type": "text", "bbox": [1]}')], "doc_id string, block string")
    assert [(r.kind, list(r.box)) for r in J.regions(blocks).collect()] == [("table", [1, 2, 4, 4])]


def test_workflow_stops_at_the_first_trouble(spark):
    rows = [(1, True, "use", "create", "use", True), (2, True, "review", "use", "use", True), (3, False, "use", "use", "use", True)]
    made = W.timeline(spark.createDataFrame(rows, "doc_id int, valid boolean, debtor string, items string, payment string, readback boolean"))
    last = {r.doc_id: r.state for r in made.groupBy("doc_id").agg(F.max_by("state", "step").alias("state")).collect()}
    assert last == {1: "FINAL_VERIFIED", 2: "MANUAL_REVIEW", 3: "FAILED"}


def test_state_machine_stream(spark, tmp_path):
    rows = [(1, i, s) for i, s in enumerate(("CREATED", "OCR_COMPLETED", "VALIDATED", "MANUAL_REVIEW", "EXTRACTED"))]
    source = spark.createDataFrame(rows, "workflow_id long, event_id long, state string").withColumn("ts", F.timestamp_seconds("event_id"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    found = states.run(states.transitions(stream), "machine")
    assert [(r.state, r.legal) for r in found.orderBy("seq").collect()] == [("CREATED", True), ("OCR_COMPLETED", True), ("VALIDATED", False), ("MANUAL_REVIEW", True), ("EXTRACTED", False)]

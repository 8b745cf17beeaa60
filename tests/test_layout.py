"""Fixtures of positioned text."""

from pyspark.sql import functions as F

from tallyweave.operators import layout as L

SPAN = "doc_id string, page int, id string, text string, x0 int, y0 int, x1 int, y1 int"


def spans(spark, rows, doc="d"):
    made = [(doc, 1, f"s{i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, SPAN).withColumn("reading_order", F.substring("id", 2, 9).cast("int"))


TOTALS = [("SUBTOTAL", 44, 612, 131, 634), ("TAX TOTAL", 402, 612, 497, 634), ("GRAND TOTAL", 706, 612, 829, 634), ("EUR 81.40", 52, 648, 140, 670), ("EUR 5.70", 410, 648, 490, 670), ("EUR 87.10", 715, 648, 806, 670), ("12.00", 900, 20, 950, 42)]


def test_totals_below_labels(spark):
    found = {r.path: r.value for r in L.trusted_totals(spans(spark, TOTALS)).collect()}
    assert found == {"totals.total_net": "81.40", "totals.total_vat": "5.70", "totals.total_gross": "87.10"}


def test_duplicate_total_labels_are_refused(spark):
    rows = [("TOTAL NET", 44, 612, 140, 634), ("SUBTOTAL", 44, 702, 131, 724), ("81.40", 44, 640, 110, 662), ("81.40", 44, 730, 110, 752)]
    assert L.trusted_totals(spans(spark, rows)).count() == 0


ADDRESSES = [("Ship to", 36, 70, 110, 92), ("Bill to", 512, 70, 580, 92), ("Lager Nord", 36, 104, 150, 126), ("Kontor AG", 512, 104, 620, 126), ("Kai 2", 36, 136, 90, 158), ("Hafenweg 9", 512, 136, 640, 158), ("20457 Hamburg", 36, 168, 190, 190), ("24103 Kiel", 512, 168, 625, 190), ("Germany", 36, 200, 120, 222), ("Germany", 512, 200, 596, 222), ("ITEMS", 36, 300, 96, 322)]


def addresses(spark, rows):
    s = spans(spark, rows)
    heights = s.groupBy(*L.PAGE).agg(F.lit(600).alias("height"))
    return {r.path: r.value for r in L.trusted_addresses(L.address_columns(s, heights)).collect()}


def test_address_columns(spark):
    found = addresses(spark, ADDRESSES)
    assert len(found) == 8
    assert found["debtor.billing_address.street"] == "Hafenweg 9"
    assert found["debtor.delivery_address.zip"] == "20457"


def test_two_postal_lines_refuse_both_columns(spark):
    assert addresses(spark, [*ADDRESSES, ("89073 Ulm", 512, 240, 600, 262)]) == {}


def test_company_under_its_own_label(spark):
    rows = [("Business name", 31, 55, 170, 77), ("Nordlicht KG", 31, 84, 160, 106), ("Contact person", 540, 55, 690, 77), ("Jo Holm", 540, 84, 620, 106), ("DEBTOR GROUP", 31, 250, 170, 272)]
    found = {r.path: r.value for r in L.trusted_fields(spans(spark, rows)).collect()}
    assert found == {"debtor.company": "Nordlicht KG", "debtor.first_name": "Jo", "debtor.last_name": "Holm"}


def test_payment_fields(spark):
    rows = [("Terms of payment", 20, 40, 180, 60), ("Cash", 196, 40, 240, 60), ("Payment status", 20, 160, 160, 180), ("overdue", 176, 160, 250, 180), ("Date paid", 20, 280, 110, 300), ("03.02.2027", 126, 280, 230, 300)]
    found = {r.path: r.value for r in L.trusted_fields(spans(spark, rows)).collect()}
    assert found == {"payment.method": "Cash", "payment.status": "OVERDUE", "payment.payment_date": "03.02.2027"}


HEAD = [("Zeile", 14, 60), ("Article No", 110, 214), ("Beschreibung", 330, 472), ("Menge", 640, 706), ("Unit price", 790, 890), ("Rabatt", 960, 1024), ("MwSt", 1080, 1130), ("Amount", 1210, 1290)]
TABLE = [(t, a, 64, b, 86) for t, a, b in HEAD]
for y, row in ((118, ("1", "K-1", "Lamp", "3", "700.00", "10%", "7%", "1,890.00")), (190, ("2", "K-22", "Shade", "1", "35.90", "0%", "7%", "35.90"))):
    TABLE += [(t, h[1], y, h[2], y + 22) for t, h in zip(row, HEAD, strict=True)]
TABLE.append(("SUBTOTAL", 640, 280, 740, 302))


def cells_of(spark, rows):
    s = spans(spark, rows)
    return L.table_cells(s, s.groupBy(*L.PAGE).agg(F.lit(1400).alias("width"), F.lit(600).alias("height")))


def test_item_table(spark):
    cells = {(r.row, r.role): r.text for r in cells_of(spark, TABLE).collect()}
    assert len(cells) == 16
    assert cells[0, "description"] == "Lamp"
    assert cells[1, "source_total"] == "35.90"
    claims = {r.path: r.value for r in L.trusted_items(cells_of(spark, TABLE)).collect()}
    assert claims["items[0].source_total"] == "1,890.00"
    assert "items[0].row_number" not in claims


def test_first_of_equal_heading_rows_counts(spark):
    shifted = [(t, a, 420, b, 442) for t, a, b in HEAD]
    heads = L.header_groups(spans(spark, TABLE + shifted))
    assert {r.y0 for r in heads.collect()} == {64}


def test_no_table_without_required_headings(spark):
    assert cells_of(spark, [r for r in TABLE if r[0] != "Article No"]).count() == 0


def test_cell_under_heading_refuses_ties(spark):
    heads = spark.createDataFrame([("d", "A", 0, 100)], "doc_id string, header string, x0 int, x1 int")
    cells = spark.createDataFrame([("d", 0, "x", 0, 0, 100, 10), ("d", 0, "y", 0, 0, 100, 10), ("d", 1, "z", 10, 0, 90, 10), ("d", 1, "w", 0, 0, 30, 10)], "doc_id string, row int, text string, x0 int, y0 int, x1 int, y1 int")
    assert [(r.row, r.text) for r in L.cell_under(heads, cells).collect()] == [(1, "z")]

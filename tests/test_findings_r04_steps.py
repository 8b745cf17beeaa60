"""What the fourth round's findings were about, in small."""

from pyspark.sql import functions as F

from tallyweave.functions import numbers as N
from tallyweave.operators import claims as C
from tallyweave.operators import layout as L
from tallyweave.operators import orders as O  # noqa: E741
from tallyweave.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.load()
CLAIM = "doc_id long, ord int, path string, value string, evidence_ids array<string>, ambiguity string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_repair_works_issues_out_once(spark):
    """the issues of a repair were worked out again for each use."""
    assert plan_of(QUERIES["q_claim_repair"](spark, SF)).count("MISSING_EVIDENCE") == 1


def test_repair_opens_paths_and_items(spark):
    """F1"""
    of = lambda rows: spark.createDataFrame([(*r, [], None) for r in rows], CLAIM)
    original = of([(1, 0, "items[0].sku", "a"), (1, 1, "currency", "EUR"), (1, 2, "debtor.last_name", "Holm"), (2, 0, "items[0].sku", "b"), (2, 1, "debtor.email", "x"), (3, 0, None, "n")])
    repaired = of([(1, 0, "items[0].sku", "A"), (1, 1, "items[1].sku", "B"), (1, 2, "currency", "USD"), (2, 0, "items[0].sku", "B"), (2, 1, "debtor.email", "y"), (2, 2, "debtor.email", "z")])
    issues = spark.createDataFrame([(1, "item_count"), (1, "debtor.company"), (2, "debtor.billing_address.email"), (2, None)], "doc_id long, path string")
    found = {(r.doc_id, r.path, r.value) for r in C.repair(original, repaired, issues).collect()}
    assert found == {(1, "items[0].sku", "A"), (1, "items[1].sku", "B"), (1, "currency", "EUR"), (2, "items[0].sku", "b"), (2, "debtor.billing_address.email", "z"), (3, None, "n")}


def test_evidence_of_many_claims(spark):
    """Claims beyond one array, ids that repeat, without text or place, or are null, and documents without spans."""
    rows = [(1, n, f"items[{n}].sku", "x", [f"e{n % 3}"], None) for n in range(C.TOGETHER + 5)] + [(1, None, "p", "x", ["e0", None, "no"], None), (2, 0, "p", "x", None, None)]
    spans = spark.createDataFrame([(1, "e0", "b"), (1, "e0", "a"), (1, "e1", None), (1, "e2", "c"), (1, None, "z")], "doc_id long, id string, text string")
    cells = spark.createDataFrame([(1, "e0", 0, "sku"), (1, "e2", None, "sku"), (1, "e1", 1, "sku")], "doc_id long, id string, row int, role string")
    found = {(r.doc_id, r.ord): (r.unknown, r.texts, r.joined, r.mapped, r.mismatched, r.has_cells) for r in C.with_evidence(spark.createDataFrame(rows, CLAIM), spans, cells).collect()}
    assert len(found) == len(rows)
    assert found[1, 0] == ([], ["a", "b"], "a b", 1, 0, True)
    assert found[1, 1] == (["e1"], [], "", 1, 0, True)
    assert found[1, 515] == ([], ["c"], "c", 0, 0, True)
    assert found[1, 513] == ([], ["a", "b"], "a b", 1, 1, True)
    assert found[1, None] == (["no"], ["a", "b"], "a b", 1, 1, True)
    assert found[2, 0] == ([], [], "", 0, 0, False)


SPAN = "doc_id long, page int, reading_order int, id string, text string, x0 int, y0 int, x1 int, y1 int"


def test_cells_are_cut_by_place(spark):
    """Each span was held against every row and column of its page."""
    assert "slice(" in plan_of(QUERIES["q_table_cells"](spark, SF))


def test_cells_of_several_spans_and_odd_places(spark):
    """cells of several spans in reading order, empty cells, text over and under the table and beyond the page, a page that is narrower than its headings."""
    heads = [("SKU", 10), ("QTY", 100), ("UNIT PRICE", 200), ("LINE TOTAL", 300)]
    rows = [(t, x, 50, x + 40, 60) for t, x in heads] + [("above", 10, 20, 50, 30), ("A-1", 10, 100, 50, 110), ("two", 120, 96, 130, 106), ("one", 100, 96, 110, 106), ("low", 105, 104, 125, 114), ("1.00", 300, 100, 340, 110)]
    rows += [("B-2", 10, 140, 50, 150), ("3", 100, 140, 140, 150), ("far", 900, 140, 940, 150), ("left", -90, 140, -50, 150), ("TOTALS", 10, 200, 50, 210), ("under", 10, 240, 50, 250)]
    spans = spark.createDataFrame([(1, p, n, f"{p}_{n}", *r) for p in (1, 2) for n, r in enumerate(rows)], SPAN)
    pages = spark.createDataFrame([(1, 1, 400, 300), (1, 2, 150, 300)], "doc_id long, page int, width int, height int")
    found = {(r.page, r.row, r.role): (r.text, tuple(r.evidence_ids)) for r in L.table_cells(spans, pages).collect()}
    for p in (1, 2):
        own = {k[1:]: v for k, v in found.items() if k[0] == p}
        last = {(0, "source_total"): ("1.00", (f"{p}_9",))} if p == 1 else {}
        assert own == {(0, "sku"): ("A-1", (f"{p}_5",)), (0, "quantity"): ("one two low", (f"{p}_7", f"{p}_6", f"{p}_8")), **last, (1, "sku"): ("B-2", (f"{p}_10",)), (1, "quantity"): ("3", (f"{p}_11",))}


def test_totals_meet_numbers_row_by_row(spark):
    """pairs of labels and numbers were held against each other in loops over arrays."""
    assert "explode(numbers" in plan_of(QUERIES["q_label_value_totals"](spark, SF))


def test_sure_numbers_are_the_only_ones(spark):
    """the short look agrees with the long one."""
    texts = ["1", "12.30", "EUR 5.70", "SKU-123", "a1", "1.234", "1,5", "7%", "x 9%", "1 2", "1" * 18, "1" * 40, "(5)", "-3", "٣ 4", "_9", "é9", "12\\n", ".5", "5.", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    told = rows.select("t", F.col("t").rlike(L.SURE_NUMBER).alias("sure"), N.only_decimal(F.col("t")).isNotNull().alias("number")).collect()
    assert all(r.number for r in told if r.sure)
    assert {"1", "12.30", "EUR 5.70", "SKU-123", "7%"} <= {r.t for r in told if r.sure}


def test_fields_of_an_order_come_as_one_map(spark):
    """What an order may have and what is claimed were moved by document and path."""
    first = spark.createDataFrame([(1, "currency", "EUR", ["a"], None), (1, "items[0].sku", "S", None, "doubt"), (1, "items[100].sku", "T", [], None), (3, "currency", "USD", [], None)], "doc_id long, path string, value string, evidence_ids array<string>, ambiguity string")
    headers = spark.createDataFrame([(1, 200, False), (2, 1, True)], "doc_id long, item_count int, delivery boolean")
    rows = O.filled(first, headers)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "path#" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
    found = {(r.doc_id, r.path): (r.value, r.evidence_ids, r.ambiguity) for r in rows.collect()}
    assert set(found) == {(r.doc_id, r.path) for r in O.expected(headers).collect()}
    assert {k: v for k, v in found.items() if v != (None, None, None)} == {(1, "currency"): ("EUR", ["a"], None), (1, "items[0].sku"): ("S", None, "doubt")}


def test_claims_that_say_what_they_cite(spark):
    """The short look for a claim that is word for word what it cites agrees with the long one."""
    texts = ["12.30", "5.00%", "-3", "007", "1,000.5", "9" * 18, "9" * 40, "abc", "12 a 3", "", " ", "-", "PAID", "2026-01-02"]
    rows = [(p, t, j) for p in ("items[0].quantity", "totals.total_net", "debtor.company", "payment.status", "order_date", "currency") for t in texts for j in (t, f"{t} ")]
    made = spark.createDataFrame(rows, "path string, value string, joined string")
    told = made.select("path", "value", "joined", C.supported(F.col("path"), F.col("value"), F.col("joined"), F.col("joined")).alias("ok")).collect()
    by = {(r.path, r.value, r.joined): r.ok for r in told}
    assert all(by[p, t, t] == by[p, t, f"{t} "] for p, t, _ in rows)
    assert by["totals.total_net", "5.00%", "5.00%"] and not by["totals.total_net", "abc", "abc"] and not by["debtor.company", " ", " "]

"""What the third round's findings were about, in small."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import containment
from tallyweave.operators import layout as L
from tallyweave.operators import payloads as P
from tallyweave.operators import rules
from tallyweave.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.load()


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for path in folder.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    mine = QUERIES[name](spark, str(folder))
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted((tuple(r[names.index(c)] for c in mine.columns) for r in cursor.fetchall()), key=repr)
    assert sorted(map(tuple, mine.collect()), key=repr) == theirs
    return theirs


def test_depths_of_more_nodes_than_recursion_may_return(spark):
    """F15"""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        tree = spark.range(1, 201).selectExpr("id AS node", "CASE WHEN id > 1 THEN floor(id / 2) END AS parent")
        rows = {r.node: r.depth for r in P.depths(tree.unionByName(spark.sql("SELECT 900L AS node, 901L AS parent"))).collect()}
        assert rows == {n: n.bit_length() - 1 for n in range(1, 201)}
        assert {r.node for r in P.depths(tree, 3).collect()} == set(range(1, 16))
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_postal_codes_of_many_customers(spark, tmp_path):
    """F16"""
    spark.range(1).selectExpr("0 AS n_nationkey", "'GERMANY' AS n_name").write.parquet(f"{tmp_path}/nation")
    spark.range(89_990, 90_030).unionByName(spark.range(5_400_000, 5_400_016)).selectExpr("id AS c_custkey", "0 AS c_nationkey").write.parquet(f"{tmp_path}/customer")
    for t in ("nation", "customer"):
        (tmp_path / t).rename(tmp_path / f"{t}.parquet")
    assert len(same_as_sql(spark, tmp_path, "q_postal_city_split")) == 56


def test_digits_of_neighbouring_cells_make_no_number(spark, tmp_path):
    """SKU-12 beside 34.00 is not 1234.00."""
    day = datetime(2026, 1, 1)
    rows = [(1, 12, 5, 1, 34.0, 36.2941, 0.0, 0.1, day), (1, 9, 5, 2, 2.0, 700.0, 0.0, 0.1, day), (2, 9, 5, 1, 2.0, 7.0, 0.0, 0.1, day)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem")
    (tmp_path / "lineitem").rename(tmp_path / "lineitem.parquet")
    assert [r[2] for r in same_as_sql(spark, tmp_path, "q_row_contains")] == [2, 2, 1]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_parted_by_document_are_not_moved_again(spark):
    """F12 and others: the windows' parting serves what is grouped by document; nothing of the size of the input is broadcast."""
    from tallyweave.sources import tables as S

    assert _plan(S.items(spark, SF).groupBy("doc_id").agg(F.max("pos"), F.max("sku"))).count("Exchange hashpartitioning") == 1
    for name in ("q_claim_unknown_ids", "q_claim_verify_priority"):
        plan = _plan(QUERIES[name](spark, SF))
        assert "BroadcastExchange" not in plan and "Exchange hashpartitioning(doc_id" in plan
        assert not any("Exchange hashpartitioning(doc_id" in x and (", id#" in x or ", ord#" in x) for x in plan.splitlines())


def test_positioned_text_moves_the_lines_once(spark):
    """One scan and one exchange of the lines, and no window over what they are spread out to."""
    for name in ("q_reading_order", "q_header_group", "q_bbox_union", "q_document_text"):
        plan = _plan(QUERIES[name](spark, SF))
        assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan and plan.count("Window [") <= 1, name
    assert [r[0] for r in spark.range(9_998, 10_002).select(T.line_id(F.col("id"))).collect()] == ["ocr_9998", "ocr_9999", "ocr_10000", "ocr_10001"]


def test_tables_are_inferred_in_the_pages_row(spark):
    """nothing but the lines is moved and no window runs over a page."""
    from pyspark.sql import types as Y

    for name in ("q_table_cells", "q_band_midpoints"):
        plan = _plan(QUERIES[name](spark, SF))
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") <= 1 and "Join" not in plan, name
    texts = ["unit price 2", "Unit (1)", "12.00", "SKU-7", "EUR 3", "Qty", "VAT (19%)"]
    told = spark.createDataFrame(texts, Y.StringType()).select("value", F.col("value").rlike(L.NO_HEADING).alias("no"), L.header_role(F.col("value")).alias("role")).collect()
    assert {r.value for r in told if r.no} == {"12.00", "SKU-7", "EUR 3"}
    assert not [r for r in told if r.no and r.role]


def test_containment_moves_by_document_and_broadcasts_nothing(spark):
    """F3, F13, F27."""
    for name in ("q_contained_assign", "q_new_row_with"):
        plan = _plan(QUERIES[name](spark, SF))
        assert "BroadcastExchange" not in plan and "doc_id" in plan
        assert not any("Exchange hashpartitioning(doc_id" in x and (", pos#" in x or ", row#" in x or ", gram#" in x) for x in plan.splitlines())
    texts = spark.range(50).selectExpr("id AS t", "concat('ab', id, 'cd') AS text")
    assert "BroadcastExchange" not in _plan(containment.pairs(texts, texts.selectExpr("t AS p", "text AS pattern")))


def test_streets_and_wrong_dates_of_whole_pages(spark, tmp_path):
    """a street with a number of four digits is no postal line, and an answer's wrong date is not the order's by chance."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    orders = [(2, 1028, "O", datetime(2001, 1, 1)), (3, 7, "F", datetime(2001, 1, 2)), (4, 7, "P", datetime(2002, 2, 2)), (5, 54321, "F", datetime(2002, 2, 2))]
    spark.createDataFrame([(k, 12, 5, 1, 2.0, 36.29, 0.0, 0.1, d) for k, _, _, d in orders], line).coalesce(1).write.parquet(f"{tmp_path}/lineitem")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders")
    spark.createDataFrame([(k, f"Customer#{k}") for k in (7, 1028, 54321)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer")
    for t in ("lineitem", "orders", "customer"):
        (tmp_path / t).rename(tmp_path / f"{t}.parquet")
    claims = {r[:2]: r[2] for r in same_as_sql(spark, tmp_path, "q_extraction_claims")}
    assert claims[2, "debtor.billing_address.street"] == "Hafenweg 1028" and claims[2, "order_date"] is None


def test_missing_evidence_moves_orders_and_counts_alone(spark):
    """both forms of the rule agree, and the query gathers no paths and broadcasts nothing."""
    plan = _plan(QUERIES["q_missing_evidence"](spark, SF))
    assert "collect_set" not in plan and "BroadcastExchange" not in plan and plan.count("Exchange hashpartitioning") == 2
    critical = spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["a"]), (3, ["x"])], "doc_id long, critical array<string>")
    rows = rules.missing_evidence(critical, spark.createDataFrame([(1, "c"), (1, "c"), (2, "a")], "doc_id long, path string"))
    assert {(r.doc_id, r.message) for r in rows.collect()} == {(1, "a, b"), (3, "x")}


def test_evidence_is_looked_up_by_id_without_failed_casts(spark):
    """Claims look their ids up in maps, repeated ids keep every text in order, and paths of no item are not cast."""
    from tallyweave.functions import numbers as N
    from tallyweave.operators import claims as C

    claims = spark.createDataFrame([(1, 0, "items[0].sku", ["a", "b", "x", None]), (1, 1, "currency", None), (2, 0, "items[1].sku", ["a", "a"]), (3, 0, "currency", ["a"])], "doc_id long, ord int, path string, evidence_ids array<string>")
    spans = spark.createDataFrame([(1, "a", "two"), (1, "a", "one"), (1, "b", None), (1, None, "no"), (2, "a", "it")], "doc_id long, id string, text string")
    cells = spark.createDataFrame([(1, "a", 0, "sku"), (1, "a", 1, "sku"), (1, "b", None, "sku"), (2, "a", 0, "sku"), (3, None, 0, "sku")], "doc_id long, id string, row int, role string")
    seen = C.with_evidence(claims, spans, cells)
    rows = {(r.doc_id, r.ord): (r.unknown, r.texts, r.joined, r.glued, r.mapped, r.mismatched, r.has_cells) for r in seen.collect()}
    assert rows == {(1, 0): (["b", "x"], ["one", "two"], "one two", "onetwo", 2, 1, True), (1, 1): ([], [], "", "", 0, 0, True), (2, 0): ([], ["it", "it"], "it it", "itit", 2, 2, True), (3, 0): (["a"], [], "", "", 0, 0, True)}
    assert "filter(said" not in _plan(seen) and "nullif" in str(C.item_index(F.col("path"))).lower()
    texts = ["12.50", "-3", "007", "0.125", "1,234.5", "(5)", "12.50\n", "-0", "", "x"]
    told = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(N.canonical_decimal(F.col("t"))).collect()]
    assert told == ["12.50", "-3", "7", "125", "1234.5", "-5", "12.50", "-0", None, None]


def test_totals_meet_their_labels_in_the_documents_row(spark):
    """one scan and one exchange, no join; labels repeated on another page and numbers as near as another refuse."""
    plan = _plan(QUERIES["q_label_value_totals"](spark, SF))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    rows = [(1, 1, "a", "NET TOTAL", 0, 0, 50, 10), (1, 1, "b", "7.00", 60, 0, 90, 10), (1, 2, "c", "8.00", 60, 0, 90, 10), (2, 1, "a", "NET TOTAL", 0, 0, 50, 10), (2, 2, "b", "net total", 0, 0, 50, 10), (2, 1, "c", "7.00", 60, 0, 90, 10)]
    rows += [(3, 1, "a", "VAT TOTAL", 0, 0, 50, 10), (3, 1, "b", "7.00", 60, 0, 90, 10), (3, 1, "c", "8.00", 60, 0, 90, 10)]
    made = spark.createDataFrame(rows, "doc_id long, page int, id string, text string, x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in L.trusted_totals(made).collect()] == [(1, "totals.total_net", "7.00", "a", "b")]


def test_pages_of_the_fixed_layout_are_read_in_the_documents_row(spark):
    """the lines, and for whole pages the orders, move once; no line of a page is a row that is moved or sorted."""
    for name, moves in (("q_legacy_orders", 2), ("q_legacy_items", 1)):
        plan = _plan(QUERIES[name](spark, SF))
        assert plan.count("Exchange hashpartitioning") == moves and plan.count("Window [") == 1 and "BroadcastExchange" not in plan, name


def test_items_of_long_and_crowded_pages(spark):
    """an anchor is compared with its neighbours in height, and with all where these are too many for that."""
    from tallyweave.operators import legacy

    cells = [("K-%d", 100), ("Lamp %d", 300), ("%d", 505), ("1%d,00", 635), ("0%%", 720), ("7%%", 785), ("4%d.00", 870)]
    text = lambda t, n: t % n if "%d" in t else t % ()
    rows = [("long", f"{n}.{x}", text(t, n), x - 20, 40 * n, x + 20, 40 * n + 10, 7 * n + k) for n in range(90) for k, (t, x) in enumerate(cells)]
    # one row of all cells, and between them more lines of one height than an anchor looks at
    rows += [("crowd", f"c{k}", text(t, 5), x - 20, 100, x + 20, 110, 500 + k) for k, (t, x) in enumerate(cells)]
    rows += [("crowd", f"x{k}", f"x{k}", 2000 + k, 100, 2001 + k, 110, k) for k in range(300)]
    spans = spark.createDataFrame([(*r, 1000) for r in rows], "doc_id string, id string, text string, x0 int, y0 int, x1 int, y1 int, reading_order int, width int")
    got = sorted((r.doc_id, r.row, r.sku, r.description, int(r.quantity), int(r.unit_net_price), int(r.source_total)) for r in legacy.item_rows(spans).collect())
    want = [("long", n, f"K-{n}", f"Lamp {n}", n, int(f"1{n}"), int(f"4{n}")) for n in range(90)]
    assert got == [("crowd", 0, "K-5", "Lamp 5", 5, 15, 45), *want]


def test_repairs_are_chosen_in_the_documents_row(spark):
    """the lines move once and no window runs over a page; documents without issues, cells or words, and repeated ids count as before."""
    from tallyweave.operators import claims as C

    plan = _plan(QUERIES["q_repair_spans"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1 and "Join" not in plan
    texts = {30: "Net  TOTAL", 45: "net total"}
    spans = spark.createDataFrame([(d, f"s{n % 90}", texts.get(n, "x"), n) for d in range(1, 7) for n in range(100)], "doc_id long, id string, text string, reading_order int")
    issues = [(1, "order_date", ["s5", None, "gone"]), (1, "currency", ["s98"]), (2, "totals.total_net", []), (2, "totals.total_net", None), (3, "items[1].sku", None), (3, "items[7].sku", []), (4, "zzz.qqq", []), (5, None, None)]
    cells = [(3, "s40", 1, "sku"), (3, "s41", 1, "quantity"), (3, "s2", 1, "sku"), (3, None, 1, "sku"), (4, "s4", 1, "sku")]
    of = lambda unicode: [(r.doc_id, r.reading_order) for r in C.repair_spans(spans, spark.createDataFrame(issues, "doc_id long, path string, evidence_ids array<string>"), spark.createDataFrame(cells, "doc_id long, id string, row int, role string"), unicode=unicode).select("doc_id", "reading_order").collect()]
    first = list(range(32))
    want = {1: [3, 4, 5, 6, 7, *range(93, 98)], 2: [*range(27, 39), *range(42, 54)], 3: [2, 40, 92], 4: first, 5: first, 6: first}
    assert sorted(of(False)) == sorted(of(True)) == [(d, n) for d, rows in want.items() for n in rows]


def test_cells_meet_headings_in_the_documents_row(spark):
    """one exchange of the lines and no join; headings of one text count together, and repeated cells are no tie."""
    plan = _plan(QUERIES["q_cell_under_header"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1 and "Join" not in plan
    heads = spark.createDataFrame([(1, "A", 0, 10), (1, "A", 50, 60), (1, "B", 0, 10), (2, "A", 0, 10)], "doc_id long, header string, x0 int, x1 int")
    cells = [(1, 1, "x", 0, 0, 5, 5), (1, 1, "x", 0, 0, 5, 5), (1, 1, "y", 50, 0, 59, 5), (1, 2, "p", 0, 0, 5, 5), (1, 2, "q", 2, 0, 7, 5), (1, 3, " ", 0, 0, 9, 5), (1, 3, "s", 8, 0, 20, 5), (3, 1, "t", 0, 0, 5, 5)]
    under = L.cell_under(heads, spark.createDataFrame(cells, "doc_id long, row int, text string, x0 int, y0 int, x1 int, y1 int"))
    assert sorted((r.header, r.row, r.text) for r in under.collect()) == [("A", 1, "y"), ("A", 3, "s"), ("B", 1, "x"), ("B", 3, "s")]


def test_payloads_are_written_in_the_documents_row(spark):
    """one exchange of the lines and no join; text that JSON has to escape is escaped."""
    import json

    plan = _plan(QUERIES["q_prompt_payload"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1 and "Join" not in plan
    texts = ["plain", 'say "x"', "a\\b", "two\nlines\n", "é ]", "", None, "]", "tab\t"]
    spans = spark.createDataFrame([(1, n, f"s{n}", t, 0.12345, 1, 2, 3, 4, 1) for n, t in enumerate(texts)], "doc_id long, reading_order int, id string, text string, confidence double, x0 int, y0 int, x1 int, y1 int, page int")
    made = P.prompt_payload(spans, spark.createDataFrame([(1, 1, 9, 9)], "doc_id long, page int, width int, height int")).collect()
    assert json.loads(made[0].payload)["spans"] == [[f"s{n}", t, 0.123, [1, 2, 3, 4]] for n, t in enumerate(texts)]

"""What a client session would show, as tables: candidates, order and invoice snapshots, payments, read-back of documents.

Every function handles all documents at once; what a session would refuse comes out as a `problem`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

CANDIDATE = ("company", "first_name", "last_name", "zip", "city")


def debtor_candidates(rows: DataFrame, key: str) -> DataFrame:
    """Candidates from the rows of a selector: columns it lacks and null cells are empty; rows that name nobody are none."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in CANDIDATE}
    made = rows.select(F.col(key).alias("record_id"), *(v.alias(c) for c, v in cells.items()))
    return made.filter("company <> '' OR first_name <> '' OR last_name <> ''")


def selected_method(wanted: DataFrame, methods: DataFrame) -> DataFrame:
    """The payment method of each document, where exactly one has the wanted name, case and outer blanks aside. wanted is (doc_id, method), methods (name)."""
    key = lambda c: F.lower(F.trim(c))
    # one row per spelling; a spelling of several methods selects none
    names = methods.groupBy(key(F.col("name")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    found = wanted.withColumn("key", key(F.col("method"))).join(names, "key", "left")
    return found.select("doc_id", F.when(F.col("n") == 1, F.col("name")).alias("method"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("selected"))


def order_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """Lines as they are added: items (doc_id, pos, sku, product_id, quantity) in the order of pos; an unknown product takes no line."""
    known = items.join(products.select(F.col("record_id").alias("product_id")).distinct(), "product_id", "left_semi")
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return known.select("doc_id", row.alias("row_index"), "pos", "sku", "product_id", "quantity")


def order_snapshot(orders: DataFrame, lines: DataFrame, debtors: DataFrame) -> DataFrame:
    """Open orders as read back, or why they cannot be: orders (doc_id, order_date, reference, debtor_id, n_items, total_gross), debtors (record_id, payment_method)."""
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    known = debtors.select(F.col("record_id").alias("debtor_id"), "payment_method")
    seen = orders.join(counts, "doc_id", "left").join(known, "debtor_id", "left").na.fill(0, ["n_lines"])
    # an unknown count of items is never reached
    whole = F.col("payment_method").isNotNull() & F.coalesce(F.col("n_lines") == F.col("n_items"), F.lit(False))
    number = F.format_string("ORD-%05d", F.col("doc_id"))
    return seen.select("doc_id", number.alias("number"), "order_date", "reference", "payment_method", "n_lines", "total_gross", F.when(whole, "open").alias("state"), F.when(~whole, "Order is incomplete").alias("problem"))


def follow_up_invoice(snapshots: DataFrame, saved: DataFrame, today: str) -> DataFrame:
    """Invoices of orders: unpaid, with the debtor's method. saved is (doc_id, document_type); without a saved order there is none."""
    orders = saved.filter("document_type = 'Order'").select("doc_id").distinct().withColumn("ordered", F.lit(True))
    seen = snapshots.filter("problem IS NULL").join(orders, "doc_id", "left")
    there = F.col("ordered").isNotNull()
    day = F.lit(today).cast("date")
    return seen.select(
        "doc_id", F.when(there, F.format_string("INV-%05d", F.col("doc_id"))).alias("number"), F.when(there, day).alias("invoice_date"), F.when(there, day).alias("service_date"), "order_date", "reference",
        F.when(there, F.col("payment_method")).alias("method"), F.when(there, "UNPAID").alias("status"), F.lit(None).cast("date").alias("payment_date"), "n_lines", "total_gross",
        F.when(~there, "Order must be saved before creating an Invoice").alias("problem"),
    )


def with_payment(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoices with their payment set, where its value is the invoice's total. payments is (doc_id, method, status, payment_date, total)."""
    p = lambda c: F.col(f"p.{c}")
    fits = p("total") == F.col("i.total_gross")
    given = p("doc_id").isNotNull() & F.col("i.problem").isNull()
    pick = lambda c: F.when(given & fits, p(c)).otherwise(F.col(f"i.{c}")).alias(c)
    problem = F.coalesce(F.col("i.problem"), F.when(given & ~F.coalesce(fits, F.lit(False)), "payment value differs from Invoice total"))
    both = invoices.alias("i").join(payments.alias("p"), F.col("i.doc_id") == p("doc_id"), "left")
    return both.select("i.doc_id", "i.number", pick("method"), pick("status"), pick("payment_date"), "i.total_gross", problem.alias("problem"))


def _first(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that fails."""
    out = F.lit(None).cast("string")
    for failed, name in reversed(checks):
        out = F.when(failed, name).otherwise(out)
    return out


DOCUMENT_FIELDS = ("document_type", "date", "reference", "state", "transaction_id")


def verify_document(expected: DataFrame, saved: DataFrame) -> DataFrame:
    """(record_id, problem): the first thing in which a saved document differs; a null problem is a match. Both have record_id, number, total and DOCUMENT_FIELDS."""
    e, s = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"s.{c}"))
    checks = [(s("record_id").isNull(), "not persisted"), (~e("number").eqNullSafe(s("number")), "identity")]
    checks += [(~e(c).eqNullSafe(s(c)), c) for c in DOCUMENT_FIELDS]
    checks += [(~F.coalesce(N.within_tolerance(e("total"), s("total")), F.lit(False)), "total")]
    both = expected.alias("e").join(saved.alias("s"), e("record_id") == s("record_id"), "left")
    return both.select("e.record_id", _first(checks).alias("problem"))


ADDRESS = ("street", "zip", "city", "country")


def verify_invoice(expected: DataFrame, actual: DataFrame, unicode: bool = False) -> DataFrame:
    """(doc_id, problem): the first thing in which an invoice differs from its order, in the order of the checks.

    Both have reference, order_date, items (array of comparable structs), total_net, total_vat, total_gross, and
    billing and delivery (structs of ADDRESS; a null delivery is the billing address).
    """
    e, a = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"a.{c}"))
    key = lambda c: F.coalesce(T.normalize_text(c, unicode), F.lit(""))
    postal = lambda c: F.coalesce(T.normalize_postal_code(c, unicode), F.lit(""))
    same = lambda x, y: _all((postal if f == "zip" else key)(x[f]) == (postal if f == "zip" else key)(y[f]) for f in ADDRESS)
    delivery = lambda side: F.coalesce(side("delivery"), side("billing"))
    apart = e("delivery").isNotNull() & ~same(e("delivery"), e("billing"))
    checks = [
        (a("doc_id").isNull(), "missing"),
        (key(e("reference")) != key(a("reference")), "reference"),
        (~e("order_date").eqNullSafe(a("order_date")), "order_date"),
        (F.size(e("items")) != F.size(a("items")), "line count"),
        (~same(e("billing"), a("billing")), "billing address"),
        (~apart & ~same(delivery(e), delivery(a)), "delivery address"),
        (F.exists(F.arrays_zip(e("items").alias("x"), a("items").alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"])), "item"),
    ]
    checks += [(~F.coalesce(N.within_tolerance(e(c), a(c)), F.lit(False)), c) for c in ("total_net", "total_vat", "total_gross")]
    both = expected.alias("e").join(actual.alias("a"), e("doc_id") == a("doc_id"), "left")
    return both.select("e.doc_id", _first([(F.coalesce(c, F.lit(False)), name) for c, name in checks]).alias("problem"))


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out

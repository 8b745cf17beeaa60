"""Golden cases of the scalar functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import dates as D
from tallyweave.functions import numbers as N
from tallyweave.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "long", type(None): "string", Decimal: "decimal(14,4)", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("printed", "value"),
    [("USD 1,839.92", "1839.92"), ("EUR 1.839,92", "1839.92"), ("1 839,92", "1839.92"), ("19%", "19"), ("1.234", "1234"), ("1,234", "1234"), ("1234.567", "1234.567"), ("0.125", "125"), ("1.234.567", "1234567"), ("12,34,567", None), ("(5.00)", "-5.00"), ("(-5)", None), (".5", None), ("5-", None), ("2026-08-14", None), ("pcs", None), ("CH-1", "-1"), ("", None), (None, None), ("007", "7")],
)
def test_canonical_decimal(spark, printed, value):
    assert one(spark, N.canonical_decimal(F.col("c")), c=printed) == value


def test_numbers_in_text(spark):
    assert one(spark, N.decimals_in_text(F.col("c")), c="4 x 310.00, 5% of CH-1 = 1,178.00 and v2") == [Decimal(4), Decimal(310), Decimal(5), Decimal(1), Decimal(1178)]


def test_money(spark):
    args = {"q": Decimal("2"), "p": Decimal("100"), "d": Decimal("10"), "v": Decimal("19")}
    net = N.line_net(F.col("q"), F.col("p"), F.col("d"))
    assert one(spark, net, **args) == Decimal("180.00")
    assert one(spark, N.line_vat(net, F.col("v")), **args) == Decimal("34.20")
    assert one(spark, N.gross_price(F.col("p"), F.col("v")), **args) == Decimal("119.00")
    assert one(spark, N.money(F.col("q") + F.lit("0.005").cast("decimal(5,3)")), **args) == Decimal("2.01")


@pytest.mark.parametrize(("printed", "value"), [("2026-08-14", dt.date(2026, 8, 14)), ("14.08.2026", dt.date(2026, 8, 14)), ("1/2/2026", dt.date(2026, 2, 1)), ("01-02-2026", dt.date(2026, 2, 1)), ("31.02.2026", None), ("14.08.26", None), (None, None)])
def test_dates(spark, printed, value):
    assert one(spark, D.date_value(F.col("c")), c=printed) == value


def test_client_dates_put_the_month_first(spark):
    assert one(spark, D.client_date(F.col("c")), c="1/2/2026") == dt.date(2026, 1, 2)
    assert one(spark, D.client_date(F.col("c")), c="Jul 18, 2026") == dt.date(2026, 7, 18)


def test_dates_in_text(spark):
    assert set(one(spark, D.dates_in_text(F.col("c")), c="on 2026-08-14, 15.08.2026 and 2026-08-14")) == {dt.date(2026, 8, 14), dt.date(2026, 8, 15)}


def test_text_keys(spark):
    assert one(spark, T.normalize_text(F.col("c")), c="  Königstraße  1 ") == "königstrasse 1"
    assert one(spark, T.normalize_text(F.col("c")), c=None) == ""
    assert one(spark, T.label_text(F.col("c")), c="Net-Total (EUR):") == "net total"
    assert one(spark, T.header_text(F.col("c")), c="# (no.)") == "#"
    assert one(spark, T.normalize_postal_code(F.col("c")), c=" D-101 15 ") == "d10115"


@pytest.mark.parametrize(("line", "pair"), [("10117 Berlin", ("10117", "Berlin")), ("Austin, 78701", ("78701", "Austin")), ("London SW1A 1AA", ("SW1A 1AA", "London")), ("10117 X 20095", None), ("Berlin", None)])
def test_postal_city(spark, line, pair):
    found = one(spark, T.postal_city(F.col("c")), c=line)
    assert (None if found is None else tuple(found)) == pair


def test_postal_city_by_country(spark):
    assert tuple(one(spark, T.postal_city_in(F.col("c"), F.col("k")), c="1234 AB Utrecht", k="Nederland")) == ("1234 AB", "Utrecht")
    assert one(spark, T.postal_city_in(F.col("c"), F.col("k")), c="1234 Wien", k="Atlantis") is None


def test_name_parts(spark):
    assert tuple(one(spark, T.contact_name(F.col("c")), c=" Ada  King Lovelace")) == ("Ada", "King Lovelace")
    assert tuple(one(spark, T.contact_name(F.col("c")), c="Ada")) == (None, "Ada")
    assert one(spark, T.disjoint_occurrences(F.col("c"), F.col("a"), F.col("b")), c="Ann Ann", a="Ann", b="Ann")
    assert not one(spark, T.disjoint_occurrences(F.col("c"), F.col("a"), F.col("b")), c="Annabel", a="Anna", b="nabel")


def test_occurrences_that_do_not_overlap(spark):
    import itertools

    words = ["a", "b", "ab", "ba", "aab", "aba", ""]
    texts = ["".join(x) for n in range(6) for x in itertools.product("ab", repeat=n)]
    rows = spark.createDataFrame([(t, p, q) for t in texts for p in words for q in words], "c string, a string, b string")
    found = {(r.c, r.a, r.b): r.d for r in rows.select("c", "a", "b", T.disjoint_occurrences(F.col("c"), F.col("a"), F.col("b")).alias("d")).collect()}
    starts = lambda t, p: [i for i in range(len(t)) if p and t.startswith(p, i)]
    for (t, p, q), got in found.items():
        assert got == any(i + len(p) <= j or j + len(q) <= i for i in starts(t, p) for j in starts(t, q)), (t, p, q)

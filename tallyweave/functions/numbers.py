"""Printed numbers and exact money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(28,8)"
#: Fixed value: a printed number, not part of a word.
TOKEN = r"(?U)(?<![\w])[-+]?(?:\d{1,3}(?:[.,   ]\d{3})+|\d+)(?:[.,]\d+)?%?(?![\w])"
#: Fixed value: a number in the form that `canonical_decimal` gives.
PLAIN = r"^-?(?:0|[1-9][0-9]*)(?:[.][0-9]{1,2})?\z"


def canonical_decimal(c: Column) -> Column:
    """Plain digits of a printed number, US or European, brackets for negative; null if it is none.

    A single separator before exactly three digits groups them.
    """
    source = F.trim(c)
    bracketed = source.startswith("(") & source.endswith(")")
    kept = F.regexp_replace(source, r"[^0-9,.+\-]", "")
    signs = F.length(F.regexp_replace(kept, r"[^+\-]", ""))
    body = F.regexp_replace(kept, r"^[+\-]", "")
    plain = (
        F.when(body.contains(",") & body.contains("."),
               F.when(body.rlike(r"^[0-9]{1,3}([.][0-9]{3})*,[0-9]+$"), F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
               .when(body.rlike(r"^[0-9]{1,3}(,[0-9]{3})*[.][0-9]+$"), F.replace(body, F.lit(","), F.lit(""))))
        .when(body.rlike(r"^[0-9]+$"), body)
        .when(body.rlike(r"^[0-9]{1,3}((,[0-9]{3})+|([.][0-9]{3})+)$"), F.regexp_replace(body, "[,.]", ""))
        .when(body.rlike(r"^[0-9]+[.,][0-9]+$"), F.replace(body, F.lit(","), F.lit(".")))
    )
    valid = (signs <= 1) & ~kept.rlike(r"^.+[+\-]") & ~(bracketed & (signs == 1))
    negative = bracketed | kept.startswith("-")
    read = F.when(valid, F.concat(F.when(negative, "-").otherwise(""), F.regexp_replace(plain, "^0+([0-9])", "$1")))
    # most are plain already: one look spares them the chain, whose parts are worked out for every mention
    return F.when(c.rlike(PLAIN), c).otherwise(read)


def parse_decimal(c: Column) -> Column:
    # most printed numbers are plain already: one look spares them the chain below, which decides on all others
    return F.when(c.rlike(r"^-?[0-9]+([.][0-9]{1,2})?$"), c).otherwise(canonical_decimal(c)).try_cast(NUMBER)


def decimals_in_text(c: Column) -> Column:
    """All numbers printed in a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), parse_decimal), lambda x: x.isNotNull())


def only_decimal(c: Column) -> Column:
    """The number of a text that holds exactly one."""
    # the list stands inside an array of one, so that it is worked out once
    alone = F.filter(F.array(decimals_in_text(c)), lambda found: F.size(found) == 1)
    return F.get(F.get(alone, F.lit(0)), F.lit(0))


def loose_decimal(c: Column) -> Column:
    """Digits with the comma as point; nothing is grouped."""
    return F.replace(F.regexp_replace(c, r"[^0-9,.\-]", ""), F.lit(","), F.lit(".")).try_cast(NUMBER)


def plain_label(c: Column) -> Column:
    """A decimal without trailing zeros."""
    s = c.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "[.]$", "")).otherwise(s)


def _cents(c: Column) -> Column:
    """A value that counts hundredths, rounded half away from zero, as an amount."""
    return (F.round(c, 0) * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)")


def money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def line_net(quantity: Column, price: Column, discount: Column) -> Column:
    """Amount of an order line, rounded to cents; no division, so no scale is lost."""
    gross = (quantity.cast("decimal(14,4)") * price.cast("decimal(14,4)")).cast("decimal(30,8)")
    return _cents(gross * (F.lit(100).cast("decimal(3,0)") - discount.cast("decimal(7,4)")))


def line_vat(net: Column, vat: Column) -> Column:
    """Tax on a rounded line amount, rounded to cents."""
    return _cents(net.cast("decimal(26,2)") * vat.cast("decimal(7,4)"))


def gross_price(price: Column, vat: Column) -> Column:
    """Unit price with tax, without discount."""
    return _cents(price.cast("decimal(30,4)") * (F.lit(100).cast("decimal(3,0)") + vat.cast("decimal(7,4)")))


def within_tolerance(a: Column, b: Column, tolerance: str = "0.01") -> Column:
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(18,2)")

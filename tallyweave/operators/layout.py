"""Positioned text: reading order, geometry scores, label-value pairs and inferred item tables.

Every step carries (doc_id, page) as equality keys, so that spatial conditions are residuals of a hash or
sort-merge join and never a nested loop over all pages.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from .unique import exactly_one, unique_best

PAGE = ["doc_id", "page"]
BOX = ["page", "id", "text", "x0", "y0", "x1", "y1"]

#: Headings of item tables by role; the last one also takes any heading with "unit" and "net" or "price".
HEADER_ROLES = {
    "row_number": ("#", "pos", "position", "row", "zeile"),
    "sku": ("sku", "item no", "item number", "article no", "article number", "artikelnummer"),
    "description": ("description", "item description", "beschreibung"),
    "quantity": ("qty", "quantity", "menge", "anzahl"),
    "unit": ("unit", "uom", "einheit"),
    "unit_net_price": ("unit price", "price net", "einzelpreis", "e preis"),
    "discount_percent": ("disc", "discount", "rabatt"),
    "vat_percent": ("vat", "tax", "mwst", "ust"),
    "source_total": ("line net", "line total", "net amount", "amount", "zeilensumme", "gesamtpreis"),
}
REQUIRED_ROLES = ("sku", "quantity", "source_total")
#: Labels that end an item table.
TABLE_END = ("totals", "net total", "total net", "vat total", "total vat", "gross total", "total gross", "subtotal", "summe netto", "mwst gesamt", "gesamt")
#: Labels of the three totals.
TOTAL_LABELS = {
    "totals.total_net": ("net total", "total net", "subtotal", "summe netto"),
    "totals.total_vat": ("vat total", "total vat", "tax total", "mwst gesamt", "ust gesamt"),
    "totals.total_gross": ("gross total", "total gross", "grand total", "gesamt"),
}
#: Labels of single fields, and what a value has to look like.
FIELD_LABELS = {
    "debtor.company": (("company", "customer company", "business name"), None),
    "debtor.contact": (("contact name", "contact person", "contact", "customer name", "name", "ansprechpartner"), None),
    "debtor.billing_address.email": (("email", "e-mail", "mail", "e - mail"), "@"),
    "debtor.billing_address.telephone": (("telephone", "phone", "tel", "mobile", "phone number", "telephone number"), r"\d{3,}"),
    "payment.payment_date": (("payment date", "paid date", "date paid"), r"\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4}"),
    "payment.status": (("paid status", "payment status", "status"), None),
    "payment.method": (("payment method", "method of payment", "payment term", "terms of payment"), None),
}
STATUS_WORDS = ("paid", "unpaid", "overdue", "refunded")
BILLING_LABELS = ("billing address", "bill to", "invoice address")
DELIVERY_LABELS = ("delivery address", "shipping address", "ship to")
#: Fixed value: plain text with a digit, outside brackets, that names no unit. No heading and no end of a table is one, so that it needs no normalisation.
NO_HEADING = r"(?s)^(?=[^0-9]*[0-9])(?!.*(?i:unit))[\x00-\x27\x29-\x7F]*$"
#: Fixed value: ASCII text with one number, of few enough digits, that is no part of a word: what `only_decimal` reads for certain.
SURE_NUMBER = r"^(?:[\x00-\x2F\x3A-\x7F]*[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F])?[0-9]{1,18}(?:[.][0-9]{1,2})?%?$"
SECTION_ENDS = ("items", "order items", "payment", "payment details", "totals", "notes", "remarks")


def one_of(c: Column, labels: dict[str, tuple[str, ...]]) -> Column:
    """The key whose labels hold the text, else null. The text, often a chain of replacements, is worked out once."""
    pairs = [F.lit(x) for key, names in labels.items() for name in names for x in (name, key)]
    return F.try_element_at(F.create_map(*pairs), c)


def header_role(text: Column, unicode: bool = False) -> Column:
    t = T.header_text(text, unicode)
    return F.coalesce(one_of(t, HEADER_ROLES), F.when(t.rlike("^(?=.*unit).*(?:net|price)"), "unit_net_price"))


def center(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2.0


def reading_order(lines: DataFrame) -> DataFrame:
    """Ids and ordinals of recognised lines, by page, top, left, bottom, right."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "y1", "x1", "text"))
    return lines.withColumn("id", T.line_id(n)).withColumn("reading_order", n - 1)


def page_size(spans: DataFrame) -> DataFrame:
    """Largest edges of a page's boxes."""
    return spans.groupBy(*PAGE).agg(F.max("x1").alias("width"), F.max("y1").alias("height"))


def rescaled(box: Column, scale: Column) -> Column:
    """Corners divided by the factor an image was enlarged by, halves to even."""
    return F.transform(box, lambda x: F.bround(x / scale).cast("int"))


def bounds(points: Column) -> Column:
    """Upright box of a polygon given as an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def nearness(kind: str, label: Column | None = None, value: Column | None = None) -> Column:
    """Nearness of value box v to label box l: below in the same columns, or right of it in the same rows. The boxes are structs, or the aliases l and v."""
    col = lambda n: F.col(n) if label is None else (label if n[0] == "l" else value)[n[2:]]
    height = F.greatest(F.lit(1), col("l.y1") - col("l.y0"), col("v.y1") - col("v.y0"))
    middle = lambda s, a, b: F.floor((col(f"{s}.{a}") + col(f"{s}.{b}")) / 2)
    aside = F.abs(middle("v", "x0", "x1") - middle("l", "x0", "x1"))
    across = F.abs(middle("v", "y0", "y1") - middle("l", "y0", "y1"))
    over = F.least(col("l.x1"), col("v.x1")) - F.greatest(col("l.x0"), col("v.x0"))
    beside = F.least(col("l.y1"), col("v.y1")) - F.greatest(col("l.y0"), col("v.y0"))
    below, right = col("v.y0") - col("l.y1"), col("v.x0") - col("l.x1")
    down, far = (8, 20) if kind == "total" else (4, 12)
    triple = lambda *x: F.struct(*(c.cast("long").alias(f"s{i}") for i, c in enumerate(x)))
    first = triple(below + aside, F.lit(0), below) if kind == "total" else triple(F.lit(0), below, aside)
    second = triple(right + across, F.lit(1), right) if kind == "total" else triple(F.lit(1), right, across)
    return F.when((over > 0) & (below >= 0) & (below <= down * height), first).when((beside > 0) & (right >= 0) & (right <= far * height), second)


def nearest_values(labels: DataFrame, values: DataFrame, kind: str = "text") -> DataFrame:
    """For each label (doc_id, page, path, ...) that is alone on its path, the one value nearest to it, if no other is as near."""
    alone = exactly_one(labels, ["doc_id", "path"])
    pairs = alone.alias("l").join(values.alias("v"), PAGE).filter(F.col("l.id") != F.col("v.id")).withColumn("score", nearness(kind)).filter("score IS NOT NULL")
    picked = pairs.select("doc_id", "page", F.col("l.path").alias("path"), F.col("l.id").alias("label_id"), F.col("v.id").alias("value_id"), F.col("v.text").alias("text"), "score")
    return unique_best(picked, ["doc_id", "path"], ["score"])


def trusted_totals(spans: DataFrame, unicode: bool = False) -> DataFrame:
    """Printed totals beside or below their labels: doc_id, path, value, label_id, value_id. A value serves one total only.

    Labels and numbers of a document meet in its row, so that the spans are read and moved once, and a pair is never a row.
    """
    text = F.col("text")
    # amounts are no labels and are spared the normalisation
    path = F.when(~text.rlike(NO_HEADING), one_of(T.label_text(text, unicode), TOTAL_LABELS))
    marked = spans.select("doc_id", *BOX, path.alias("path")).select("doc_id", *BOX, "path", (F.col("path").isNull() & (text.rlike(SURE_NUMBER) | text.rlike(r"\p{Nd}") & N.only_decimal(text).isNotNull())).alias("number"))
    box = F.struct(*BOX, "path")
    docs = marked.groupBy("doc_id").agg(F.collect_list(F.when(F.col("path").isNotNull(), box)).alias("labels"), F.collect_list(F.when(F.col("number"), box)).alias("numbers"))
    alone = F.filter("labels", lambda x: F.size(F.filter("labels", lambda y: y["path"] == x["path"])) == 1)
    # pairs are made row by row, which is compiled; those that are not near each other go at once
    pairs = _once(docs, alone=alone).select("doc_id", "numbers", F.explode("alone").alias("l")).select("doc_id", "l", F.explode("numbers").alias("v"))
    scored = pairs.filter((F.col("l.page") == F.col("v.page")) & (F.col("l.id") != F.col("v.id"))).withColumn("score", nearness("total", F.col("l"), F.col("v"))).filter("score IS NOT NULL")
    found = unique_best(scored.withColumn("path", F.col("l.path")), ["doc_id", "path"], ["score"]).select("doc_id", "path", F.col("l.id").alias("label_id"), "v")
    alone = exactly_one(found.select("doc_id", "path", "label_id", F.col("v.id").alias("value_id"), "v.text"), ["doc_id", "value_id"])
    return alone.select("doc_id", "path", N.canonical_decimal(F.regexp_extract(F.col("text"), N.TOKEN, 0)).alias("value"), "label_id", "value_id")


def trusted_fields(spans: DataFrame, unicode: bool = False) -> DataFrame:
    """Values of explicitly labelled single fields; a contact name is split into first and last."""
    label = T.label_text(F.col("text"), unicode)
    marked = spans.withColumn("path", one_of(label, {k: v[0] for k, v in FIELD_LABELS.items()})).filter("path IS NOT NULL")
    needs = [(k, shape) for k, (_, shape) in FIELD_LABELS.items() if shape]
    alone = exactly_one(marked, ["doc_id", "path"])
    pairs = alone.alias("l").join(spans.filter(F.trim("text") != "").alias("v"), PAGE).filter(F.col("l.id") != F.col("v.id"))
    fits = (F.col("l.path") != "payment.status") | T.label_text(F.col("v.text"), unicode).isin(*STATUS_WORDS)
    for path, shape in needs:
        fits = fits & ((F.col("l.path") != path) | F.col("v.text").rlike(shape))
    scored = pairs.filter(fits).withColumn("score", nearness("text")).filter("score IS NOT NULL")
    picked = scored.select("doc_id", F.col("l.path").alias("path"), F.col("l.id").alias("label_id"), F.col("v.id").alias("value_id"), F.trim("v.text").alias("value"), "score")
    best = unique_best(picked, ["doc_id", "path"], ["score"])
    name = T.contact_name(F.col("value"))
    parts = F.when(F.col("path") == "debtor.contact", F.array(F.struct(F.lit("debtor.first_name").alias("path"), name["first_name"].alias("value")), F.struct(F.lit("debtor.last_name").alias("path"), name["last_name"].alias("value"))))
    status = F.when(F.col("path") == "payment.status", F.upper(T.label_text(F.col("value"), unicode))).otherwise(F.col("value"))
    plain = F.array(F.struct(F.col("path").alias("path"), status.alias("value")))
    return best.select("doc_id", F.explode(F.coalesce(parts, plain)).alias("c"), "label_id", "value_id").select("doc_id", "c.path", "c.value", "label_id", "value_id").filter("value IS NOT NULL")


def address_heads(spans: DataFrame, unicode: bool = False) -> DataFrame:
    """Documents with one billing and one delivery heading side by side on one page: their centres, bottoms and the line between them."""
    label = T.label_text(F.col("text"), unicode)
    marked = spans.withColumn("label", label)
    kinds = marked.withColumn("kind", F.when(F.col("label").isin(*BILLING_LABELS), "billing").when(F.col("label").isin(*DELIVERY_LABELS), "delivery")).filter("kind IS NOT NULL")
    cx = center("x0", "x1")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    return (
        kinds.groupBy("doc_id")
        .agg(F.count_if(F.col("kind") == "billing").alias("b"), F.count_if(F.col("kind") == "delivery").alias("d"), F.countDistinct("page").alias("pages"), F.max("page").alias("page"),
             pick("billing", cx).alias("bx"), pick("delivery", cx).alias("dx"), pick("billing", F.col("y1")).alias("by"), pick("delivery", F.col("y1")).alias("dy"))
        .filter("b = 1 AND d = 1 AND pages = 1 AND bx <> dx")
        .select("doc_id", "page", "bx", "dx", "by", "dy", ((F.col("bx") + F.col("dx")) / 2).alias("divider"))
    )


def address_columns(spans: DataFrame, heights: DataFrame, unicode: bool = False) -> DataFrame:
    """Spans under two side-by-side address headings: doc_id, page, kind and the span; heights has (doc_id, page, height)."""
    marked = spans.withColumn("label", T.label_text(F.col("text"), unicode))
    cx = center("x0", "x1")
    heads = address_heads(spans, unicode)
    ends = marked.filter(F.col("label").isin(*SECTION_ENDS)).select(*PAGE, "y0")
    bottom = heads.join(ends, PAGE, "left").groupBy(*heads.columns).agg(F.min(F.when(F.col("y0") > F.greatest("by", "dy"), F.col("y0"))).alias("end"))
    bottom = bottom.join(heights.select(*PAGE, "height"), PAGE, "left").withColumn("end", F.coalesce("end", "height"))
    inside = marked.join(bottom, PAGE).filter(~F.col("label").isin(*BILLING_LABELS, *DELIVERY_LABELS) & (F.col("y0") < F.col("end")))
    left = cx < F.col("divider")
    billing = left == (F.col("bx") < F.col("divider"))
    kind = F.when(billing, "billing").otherwise("delivery")
    return inside.withColumn("kind", kind).filter(F.col("y0") >= F.when(F.col("kind") == "billing", F.col("by")).otherwise(F.col("dy"))).drop("label", "bx", "dx", "by", "dy", "divider", "end", "height")


def trusted_addresses(columns: DataFrame, unicode: bool = False) -> DataFrame:
    """Street, postal code, city and country of each column: the lines just above and below its only postal line.

    Both columns of a document have to give all four, else neither counts.
    """
    rows = columns.withColumn("cy", center("y0", "y1")).withColumn("pc", T.postal_city(F.col("text"), unicode))
    postal = exactly_one(rows.filter("pc IS NOT NULL"), ["doc_id", "kind"])
    postal = postal.select("doc_id", "kind", F.col("id").alias("postal_id"), "pc", F.col("cy").alias("py"), F.col("y0").alias("p0"), F.col("y1").alias("p1"))
    near = rows.drop("pc").join(postal, ["doc_id", "kind"])
    span = F.struct("text", "id", "y0", "y1")
    # of equally near lines the first in reading order counts
    above = F.max_by(span, F.when(F.col("cy") < F.col("py"), F.struct("cy", (-F.col("y0")).alias("a"), (-F.col("x0")).alias("b"))))
    below = F.min_by(span, F.when(F.col("cy") > F.col("py"), F.struct("cy", "y0", "x0")))
    found = near.groupBy("doc_id", "kind", "postal_id", "pc", "p0", "p1").agg(above.alias("street"), below.alias("country"))
    gap = 4 * F.greatest(F.lit(1), F.col("p1") - F.col("p0"))
    country = F.trim("country.text")
    good = (
        F.col("street").isNotNull() & country.rlike(r"\p{L}") & ~country.rlike("[0-9]")
        & (F.col("p0") - F.col("street.y1") <= gap) & (F.col("country.y0") - F.col("p1") <= gap)
    )
    whole = found.filter(good).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter("n = 2")
    claim = lambda field, value, ident: F.struct(F.concat(F.lit("debtor."), F.col("kind"), F.lit(f"_address.{field}")).alias("path"), value.alias("value"), F.array(ident).alias("evidence_ids"))
    claims = F.array(claim("street", F.trim("street.text"), F.col("street.id")), claim("zip", F.col("pc.postal"), F.col("postal_id")), claim("city", F.col("pc.city"), F.col("postal_id")), claim("country", country, F.col("country.id")))
    return whole.select("doc_id", F.explode(claims).alias("c")).select("doc_id", "c.*")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns, each worked out once however often, or in how many loops, it is mentioned later."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    at = lambda i: F.get(sorted_values, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0


def page_rows(spans: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Each page as one row: PAGE, its spans as an array, and its width and height where pages are given. The spans are moved once."""
    gathered = spans.groupBy(*PAGE).agg(F.collect_list(F.struct("reading_order", "id", "text", "x0", "y0", "x1", "y1")).alias("spans"))
    return gathered if pages is None else gathered.join(pages.select(*PAGE, "width", "height").hint("merge"), PAGE)


def headed_rows(rows: DataFrame, unicode: bool = False) -> DataFrame:
    """Page rows that have a heading row: with `heads`, the spans with a role within a tolerance of the anchor with most roles (the first of equals).

    `ends` are the middles of the labels that end a table. Only text that may be a label is normalised; all other spans stay as they are.
    """
    names = ("reading_order", "id", "x0", "y0", "x1", "y1")
    middle = lambda x, a, b: (x[a] + x[b]) / 2.0
    worded = F.filter("spans", lambda x: ~x["text"].rlike(NO_HEADING) & x["text"].rlike(r"[\p{L}#]"))
    lettered = F.transform(worded, lambda x: F.struct(*(x[n].alias(n) for n in names), T.header_text(x["text"], unicode).alias("key")))
    role = lambda key: F.coalesce(one_of(key, HEADER_ROLES), F.when(key.rlike("^(?=.*unit).*(?:net|price)"), "unit_net_price"))
    told = F.transform("lettered", lambda x: F.struct(x["reading_order"].alias("reading_order"), x["id"].alias("id"), role(x["key"]).alias("role"), middle(x, "x0", "x1").alias("cx"), middle(x, "y0", "y1").alias("cy"), *(x[n].alias(n) for n in ("x0", "y0", "x1", "y1"))))
    ends = F.transform(F.filter("lettered", lambda x: x["key"].isin(*TABLE_END)), lambda x: middle(x, "y0", "y1"))
    marked = _once(_once(rows, lettered=lettered), told=told, ends=ends).drop("lettered")
    found = _once(marked, every=F.sort_array(F.filter("told", lambda x: x["role"].isNotNull()))).drop("told")
    heights = F.sort_array(F.transform("every", lambda x: F.greatest(F.lit(1), x["y1"] - x["y0"])))
    found = _once(_once(found, heights=heights, levels=F.col("every.cy")), slack=F.greatest(F.lit(12), F.floor(_median(F.col("heights")) * 1.25))).drop("heights")
    near = lambda cy: F.filter("every", lambda m: F.abs(m["cy"] - cy) <= F.col("slack"))
    # anchors of one height have the same spans near them, and the first of them comes first
    groups = F.transform(F.array_distinct("levels"), lambda cy: F.struct(cy.alias("cy"), F.array_distinct(F.transform(near(cy), lambda m: m["role"])).alias("roles")))
    found = _once(found, groups=groups)

    def size(g: Column) -> Column:
        needed = F.size(F.array_intersect(g["roles"], F.array(*map(F.lit, REQUIRED_ROLES))))
        first = F.get("every", (F.array_position("levels", g["cy"]) - 1).cast("int"))
        return F.struct(F.size(g["roles"]).alias("roles"), needed.alias("needed"), (-first["reading_order"]).alias("first"), g["cy"].alias("cy"))

    best = _once(found, best=F.array_max(F.transform("groups", size))).filter("best.roles >= 4 AND best.needed >= 3")
    return _once(best, heads=near(F.col("best.cy"))).drop("every", "slack", "best", "groups", "levels")


def header_groups(spans: DataFrame, unicode: bool = False) -> DataFrame:
    """The spans of the heading row of each page."""
    rows = headed_rows(page_rows(spans.filter(F.col("text").rlike(r"[\p{L}#]"))), unicode)
    return rows.select(*PAGE, F.explode("heads").alias("h")).select(*PAGE, "h.*").drop("cx")


def banded_rows(headed: DataFrame) -> DataFrame:
    """Rows with `heads` and `width`, with the column bands from the middles between headings as `columns` and the headings' `top`; all required roles have to be there."""
    centred = _once(headed, centre=_median(F.sort_array(F.transform("heads", lambda x: x["cy"]))))
    of_role = lambda r: F.array_min(F.transform(F.filter("heads", lambda x: x["role"] == r), lambda x: F.struct(F.abs(x["cy"] - F.col("centre")).alias("off"), x["reading_order"].alias("reading_order"), ((x["x0"] + x["x1"]) / 2.0).alias("cx"), x["role"].alias("role"), x["id"].alias("id"), x["y1"].alias("y1"))))
    roles = F.array_distinct(F.transform("heads", lambda x: x["role"]))
    kept = lambda x, cx: F.struct(cx.alias("cx"), x["reading_order"].alias("reading_order"), x["role"].alias("role"), x["id"].alias("id"), x["y1"].alias("y1"))
    # headings of different roles need no choice
    alone = F.size(F.array_distinct("heads.role")) == F.size("heads")
    across = F.sort_array(F.when(alone, F.transform("heads", lambda x: kept(x, (x["x0"] + x["x1"]) / 2.0))).otherwise(F.transform(F.transform(roles, of_role), lambda x: kept(x, x["cx"]))))
    chosen = _once(centred, chosen=across).filter(F.forall(F.array(*map(F.lit, REQUIRED_ROLES)), lambda r: F.exists("chosen", lambda x: x["role"] == r)))
    middle = lambda a, b: F.floor((a["cx"] + b["cx"]) / 2).cast("int")
    at = lambda i: F.get("chosen", i)
    band = lambda x, i: F.struct(x["role"].alias("role"), x["id"].alias("header_id"), F.when(i > 0, middle(at(i - 1), x)).otherwise(F.lit(0)).alias("x0"), F.when(i + 1 < F.size("chosen"), middle(x, at(i + 1))).otherwise(F.col("width")).alias("x1"))
    return _once(chosen, columns=F.transform("chosen", band), top=F.array_max(F.transform("chosen", lambda x: x["y1"]))).drop("centre", "chosen", "heads")


def column_rows(banded: DataFrame) -> DataFrame:
    return banded.select(*PAGE, F.explode("columns").alias("c"), F.col("top").alias("header_bottom")).select(*PAGE, "c.*", "header_bottom")


def table_columns(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """Column bands of each page from the middles between its headings; all required roles have to be there."""
    heads = headers.groupBy(*PAGE).agg(F.collect_list(F.struct("reading_order", "id", "role", "cy", "x0", "x1", "y1")).alias("heads"))
    return column_rows(banded_rows(heads.join(pages.select(*PAGE, "width").hint("merge"), PAGE)))


def _below(values: str, x: Column) -> Column:
    """How many of a column of ascending doubles are less than x."""
    return F.array_position(F.sort_array(F.concat(F.col(values), F.array(x.cast("double")))), x.cast("double")).cast("int") - 1


def cell_rows(rows: DataFrame, unicode: bool = False) -> DataFrame:
    """Cells of the item table of each page row: doc_id, page, row, role, text, evidence_ids. Rows are anchored by SKU cells.

    All of it is worked out in the page's row, so that nothing but the rows is moved. Each span is looked at once: its column is found by
    halving, its row by its place in the order of heights. Loops run over arrays of spans only where a cell has several.
    """
    shaped = banded_rows(headed_rows(rows, unicode))
    bottom = F.floor(F.array_min(F.filter("ends", lambda y: y > F.col("top"))))
    lines = [f"__m{i}" for i in range(len(HEADER_ROLES) - 1)]
    # the lines between columns, in order; those that lack are beyond all spans
    between = {n: F.coalesce(F.when(F.size("columns") > i + 1, F.get("columns.x1", F.lit(i))).cast("double"), F.lit(float("inf"))) for i, n in enumerate(lines)}
    shaped = shaped.select("*", F.coalesce(bottom, F.col("height")).alias("bottom"), (F.array_position("columns.role", F.lit("sku")) - 1).cast("int").alias("sku"), *(c.alias(n) for n, c in between.items()))
    # the page's edges bound the outer columns only
    shaped = shaped.select("*", F.least(F.lit(0.0), lines[0]).alias("left"), F.greatest("width", F.get("columns.x0", F.size("columns") - 1)).alias("right"))
    middled = F.transform("spans", lambda x: F.struct(((x["y0"] + x["y1"]) / 2.0).alias("cy"), ((x["x0"] + x["x1"]) / 2.0).alias("cx"), x.alias("x")))
    inside = F.filter(middled, lambda p: (p["cy"] > F.floor(F.col("top"))) & (p["cy"] < F.col("bottom")) & (p["cx"] >= F.col("left")) & (p["cx"] < F.col("right")))

    def column(cx: Column, low: int = 0, high: int = len(lines)) -> Column:
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(cx < F.col(lines[at]), column(cx, low, at)).otherwise(column(cx, at + 1, high))

    fields = ("y0", "x0", "reading_order", "text", "id")
    ids = F.lit(None).cast("array<string>")
    place = lambda p: F.struct(p["cy"].alias("cy"), *(p["x"][n].alias(n) for n in fields), column(p["cx"]).alias("at"), ids.alias("ids"))
    placed = _once(_once(shaped, inside=inside).drop("spans"), placed=F.sort_array(F.transform("inside", place))).drop("inside", "left", "right", *lines)
    anchor = F.filter("placed", lambda p: (p["at"] == F.col("sku")) & (p["cy"] > F.col("top")) & (p["id"] != F.get("columns", F.col("sku"))["header_id"]))
    placed = _once(placed, up=F.col("placed.cy"), down=F.transform(F.reverse("placed.cy"), lambda y: -y), anchors=F.transform(anchor, lambda p: p["cy"]))
    middle = lambda i, j: F.floor((F.get("anchors", i) + F.get("anchors", j)) / 2)
    by_row = placed.select(*PAGE, F.col("columns.role").alias("roles"), "placed", "top", "bottom", "up", "down", "anchors", F.posexplode("anchors").alias("row", "__cy"))
    low = F.when(F.col("row") > 0, middle(F.col("row") - 1, F.col("row"))).otherwise(F.col("top"))
    high = F.when(F.col("row") + 1 < F.size("anchors"), middle(F.col("row"), F.col("row") + 1)).otherwise(F.col("bottom"))
    first, last = F.size("up") - _below("down", -low), _below("up", high)
    own = by_row.select(*PAGE, "roles", "row", F.slice("placed", first + 1, F.greatest(last - first, F.lit(0))).alias("own"))
    of = lambda at: F.sort_array(F.transform(F.filter("own", lambda p: p["at"] == at), lambda p: F.struct(*(p[n].alias(n) for n in fields))))
    typed = own.schema["own"].dataType.elementType
    none = lambda n: F.lit(None).cast(typed[n].dataType).alias(n)
    joined = lambda g: F.struct(*(none(n) for n in ("cy", "y0", "x0", "reading_order")), F.array_join(F.transform(g["of"], lambda y: y["text"]), " ").alias("text"), none("id"), g["at"].alias("at"), F.transform(g["of"], lambda y: y["id"]).alias("ids"))
    several = F.transform(F.transform(F.array_distinct("own.at"), lambda at: F.struct(at.alias("at"), of(at).alias("of"))), joined)
    alone = F.size(F.array_distinct("own.at")) == F.size("own")
    # the outer form spares a filter that would cut the slices twice
    cells = own.select(*PAGE, "roles", "row", F.when(alone, F.col("own")).otherwise(several).alias("cells")).select(*PAGE, "roles", "row", F.explode_outer("cells").alias("c")).filter("c IS NOT NULL")
    return cells.select(*PAGE, "row", F.get("roles", F.col("c.at")).alias("role"), F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.ids", F.array("c.id")).alias("evidence_ids"))


def table_cells(spans: DataFrame, pages: DataFrame, unicode: bool = False) -> DataFrame:
    """Cells of the item table of each page, as `cell_rows` gives them."""
    return cell_rows(page_rows(spans, pages), unicode)


def cell_index(cells: DataFrame) -> DataFrame:
    """(doc_id, id, row, role): rows counted through the pages of a document; of several cells of an id the last counts."""
    per_page = cells.groupBy(*PAGE).agg((F.max("row") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = cells.join(per_page.select(*PAGE, before.alias("before")), PAGE)
    every = shifted.select("doc_id", F.explode("evidence_ids").alias("id"), (F.col("row") + F.col("before")).alias("row"), "role")
    last = Window.partitionBy("doc_id", "id").orderBy(F.desc("row"), F.desc("role"))
    return every.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")


def trusted_items(cells: DataFrame) -> DataFrame:
    """Item claims read off table cells; a numeric cell has to hold exactly one number."""
    per_page = cells.groupBy(*PAGE).agg((F.max("row") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numeric = ("quantity", "unit_net_price", "vat_percent", "discount_percent", "source_total")
    value = F.trim("text")
    good = (value != "") & F.col("role").isin("sku", "description", *numeric) & (~F.col("role").isin(*numeric) | N.only_decimal(value).isNotNull())
    placed = cells.join(per_page.select(*PAGE, before.alias("before")), PAGE).filter(good)
    index = F.col("row") + F.col("before")
    return placed.select("doc_id", F.concat(F.lit("items["), index.cast("string"), F.lit("]."), "role").alias("path"), value.alias("value"), "evidence_ids")


def field_evidence(cited: DataFrame) -> DataFrame:
    """Joint evidence of a field: cited has (doc_id, path, pos, text, confidence, box, page). The box is null across pages."""
    one = F.countDistinct("page") == 1
    edge = lambda f, c: F.when(one, f(c)).alias(c)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " | ")
    return cited.groupBy("doc_id", "path").agg(texts.alias("source_text"), F.min("confidence").alias("confidence"), edge(F.min, "x0"), edge(F.min, "y0"), edge(F.max, "x1"), edge(F.max, "y1"), F.min_by("page", "pos").alias("page"))


def cell_under(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """For each heading and grid row the text of the cell that covers most of it, the smallest of equals; other texts as good refuse it.

    headers has (doc_id, header, x0, x1); cells has (doc_id, row, text, box).
    """
    heads = headers.groupBy("doc_id").agg(F.collect_list(F.struct("header", "x0", "x1")).alias("headers"))
    own = cells.groupBy("doc_id").agg(F.collect_list(F.struct("row", "text", "x0", "y0", "x1", "y1")).alias("cells"))
    return cell_under_rows(heads.join(own.hint("merge"), "doc_id"))


def cell_under_rows(rows: DataFrame) -> DataFrame:
    """`cell_under` of documents in one row each: doc_id, headers and cells as arrays. Only cells that a heading covers are sorted."""
    overlap = lambda h, c: F.least(h["x1"], c["x1"]) - F.greatest(h["x0"], c["x0"])
    area = lambda c: F.greatest(F.lit(1), (c["x1"] - c["x0"]) * (c["y1"] - c["y0"]))
    score = lambda h, c: F.struct(c["row"].alias("row"), (-overlap(h, c)).alias("cover"), area(c).alias("area"), c["text"].alias("text"))
    covered = lambda h: F.transform(F.filter("cells", lambda c: (overlap(h, c) > 0) & (F.trim(c["text"]) != "")), lambda c: score(h, c))
    named = rows.select("doc_id", "headers", "cells", F.explode(F.array_distinct(F.transform("headers", lambda h: h["header"]))).alias("header"))
    found = _once(named, found=F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter("headers", lambda h: h["header"].eqNullSafe(F.col("header"))), covered)))))
    at = lambda i: F.get("found", i)
    same = lambda x, y, *names: reduce(and_, (x[n].eqNullSafe(y[n]) for n in names))
    first = lambda x, i: (i == 0) | ~same(x, at(i - 1), "row")
    alone = lambda x, i: (i + 1 >= F.size("found")) | ~same(x, at(i + 1), "row", "cover", "area")
    best = F.transform(F.filter("found", lambda x, i: first(x, i) & alone(x, i)), lambda x: F.struct(x["row"].alias("row"), x["text"].alias("text")))
    return found.select("doc_id", "header", F.inline(best))

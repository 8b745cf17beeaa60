"""Claims with provenance: long rows (doc_id, ord, path, value, evidence_ids, ambiguity) that are verified, merged, repaired and pivoted.

Headers are (doc_id, item_count, delivery). All steps are partitioned by document; order within one is `ord`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from .layout import _once
from .unique import first_of, last_of, override

#: The paths a claim may have, and which of them an order needs.
ROOT_PATHS = ("order_date", "external_reference", "currency", "debtor.company", "debtor.first_name", "debtor.last_name", "debtor.alias", "debtor.salutation", "payment.method", "payment.status", "payment.payment_date", "totals.total_net", "totals.total_vat", "totals.total_gross")
REQUIRED_PATHS = ("order_date", "external_reference", "currency", "debtor.billing_address.street", "debtor.billing_address.zip", "debtor.billing_address.city", "debtor.billing_address.country", "payment.method", "payment.status", "totals.total_net", "totals.total_vat", "totals.total_gross")
ADDRESS_FIELDS = ("street", "zip", "city", "country", "email", "telephone", "additional_name", "address_specification", "district")
ITEM_FIELDS = ("sku", "description", "quantity", "unit_net_price", "vat_percent", "discount_percent", "source_total")
IDENTITY_PATHS = ("debtor.company", "debtor.first_name", "debtor.last_name")
PLACEHOLDERS = ("-", "--", "—", "n/a", "na", "not applicable")
OPTIONAL_PATHS = ("debtor.company", "debtor.first_name", "debtor.last_name", "debtor.alias", "debtor.salutation", "payment.payment_date")
ALIASES = {"debtor.email": "debtor.billing_address.email", "debtor.telephone": "debtor.billing_address.telephone"}
CURRENCY_MARKS = {"EUR": ("eur", "€", "euro"), "USD": ("usd", "$", "dollar"), "GBP": ("gbp", "£", "pound")}
STATUSES = ("PAID", "UNPAID", "OVERDUE", "PARTIALLY PAID", "REFUNDED")
_ITEM = r"^items\[(\d+)]\.([a-z_]+)$"
_NUMERIC = r"(quantity|unit_net_price|vat_percent|discount_percent|source_total|total_net|total_vat|total_gross)$"


def aliased(path: Column) -> Column:
    out = path
    for old, new in ALIASES.items():
        out = F.when(path == old, new).otherwise(out)
    return out


def item_index(path: Column) -> Column:
    # a failed cast throws and catches, which takes longer than all else that is done for a claim: paths of no item are not cast
    return F.nullif(F.regexp_extract(path, _ITEM, 1), F.lit("")).try_cast("int")


def item_field(path: Column) -> Column:
    return F.regexp_extract(path, _ITEM, 2)


def allowed(path: Column, item_count: Column, delivery: Column) -> Column:
    """Whether a path may be claimed: known roots, address fields, items that exist."""
    address = r"^debtor\.(billing_address|delivery_address)\.([a-z_]+)$"
    kind = F.regexp_extract(path, address, 1)
    in_address = F.regexp_extract(path, address, 2).isin(*ADDRESS_FIELDS) & ((kind != "delivery_address") | delivery)
    in_items = item_field(path).isin(*ITEM_FIELDS) & (item_index(path) < item_count)
    return path.isin(*ROOT_PATHS) | F.coalesce(in_address, F.lit(False)) | F.coalesce(in_items, F.lit(False))


def has_value(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def _currency(value: Column, source: Column) -> Column:
    code = F.upper(F.trim(value))
    out = source.contains(F.lower(F.trim(value)))
    for known, marks in CURRENCY_MARKS.items():
        out = F.when(code == known, F.exists(F.array(*map(F.lit, marks)), lambda m: source.contains(m))).otherwise(out)
    return out


def supported(path: Column, value: Column, joined: Column, glued: Column, unicode: bool = False) -> Column:
    """Whether cited text bears a value out: numbers and dates by value, statuses as words, text as a part."""
    words = F.transform(F.regexp_extract_all(T.source_text(joined, unicode), F.lit(r"(?i)\b(?:PARTIALLY\s+PAID|UNPAID|OVERDUE|REFUNDED|PAID)\b"), F.lit(0)), F.upper)
    text = T.source_text(value, unicode)
    part = (text != "") & (T.source_text(joined, unicode).contains(text) | T.source_text(glued, unicode).contains(text))
    number = F.array_contains(N.decimals_in_text(joined), N.parse_decimal(value))
    day = F.array_contains(D.dates_in_text(joined), D.date_value(value))
    # most claims say what they cite word for word: a plain number or text with a letter or digit then needs no reading
    same, numeric = value == joined, path.rlike(_NUMERIC)
    out = (
        F.when(same & numeric & value.rlike(r"^-?(?:0|[1-9][0-9]*)(?:[.][0-9]{1,2})?%?\z") & (F.length(value) <= 18), True)
        .when(numeric, number)
        .when(path.isin("order_date", "payment.payment_date"), day)
        .when(path == "payment.status", F.array_contains(words, F.upper(text)))
        .when(path == "currency", _currency(value, T.folded(joined, unicode)))
        .when(same & value.rlike("[A-Za-z0-9]"), True)
        .otherwise(part)
    )
    return F.coalesce(out, F.lit(False))


def proven(kind: str, value: Column, joined: Column, glued: Column, unicode: bool = False) -> Column:
    """The authorising form of `supported`: a paid status is not borne out by a text that also says unpaid."""
    if kind != "status":
        path = {"number": "x.quantity", "percentage": "x.vat_percent", "date": "order_date", "currency": "currency"}.get(kind, "x")
        return supported(F.lit(path), value, joined, glued, unicode)
    source, status = F.lower(T.source_text(joined, unicode)), F.upper(F.trim(value))
    word = F.concat(F.lit(r"\b"), F.replace(F.lower(status), F.lit(" "), F.lit(r"\s+")), F.lit(r"\b"))
    other = (status == "PAID") & source.rlike(r"\b(?:unpaid|partially\s+paid)\b")
    return status.isin(*STATUSES) & ~other & F.regexp_like(source, word)


def canonical(kind: str, value: Column, unicode: bool = False) -> Column:
    """A value as it is stored: plain decimals, ISO dates, upper-case codes."""
    if kind in ("number", "percentage"):
        return F.coalesce(N.canonical_decimal(value), value)
    if kind == "date":
        return F.coalesce(D.date_value(value).cast("string"), value)
    if kind == "currency":
        return F.upper(F.trim(value))
    return F.upper(T.source_text(value, unicode)) if kind == "status" else value


#: How many claims of a document, by their order, are looked up in one row: what is gathered is bounded however much is claimed.
TOGETHER = 512


def _by_id(rows: DataFrame, name: str, value: Column, one: Callable[[Column], Column], every: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, name): what the rows of each document say by id, as a map; `every` makes the values of an id what is kept of them, `one` a single value.

    Ids are nearly always the rows' own, and then the map is made in one go; only the rows of a document that repeats some are searched for each.
    """
    held, kept = F.col("__held"), lambda x: x["id"].isNotNull()
    rows = rows.groupBy("doc_id").agg(F.collect_list(F.struct("id", value.alias("v"))).alias("__held"), F.count("id").alias("__n"))
    entry = lambda i, of: F.struct(i.alias("id"), of.alias("of"))
    own = (F.size(F.array_distinct(held["id"])) == F.col("__n")) & (F.size(held) == F.col("__n"))
    several = F.transform(F.array_distinct(F.transform(F.filter(held, kept), lambda x: x["id"])), lambda i: entry(i, every(F.transform(F.filter(held, lambda x: x["id"] == i), lambda x: x["v"]))))
    by_id = F.when(own, F.map_from_entries(F.transform(held, lambda x: entry(x["id"], one(x["v"]))))).otherwise(F.map_from_entries(several))
    return rows.select("doc_id", by_id.alias(name)).hint("merge")


def with_evidence(claims: DataFrame, spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims with what their evidence says: unknown ids, joined texts, and whether cells disagree with the item path.

    Adds unknown (array), texts (array), joined, glued, mapped, mismatched, has_cells. The texts and cells of a document, as maps by id, meet
    its claims as arrays of TOGETHER: nothing parted by document is moved, and the maps are copied once for an array and not for every claim.
    """
    none = F.array().cast("array<string>")
    text = lambda v: F.when(v.isNotNull(), F.array(v)).otherwise(none)
    place = lambda v: F.when(v["row"].isNotNull(), F.array(v)).otherwise(F.array().cast("array<struct<row:int,role:string>>"))
    cells = cells.select("doc_id", "id", F.col("row").cast("int").alias("row"), "role")
    said = _by_id(spans, "said", F.col("text"), text, lambda of: F.array_sort(F.array_compact(of)))
    placed = _by_id(cells, "placed", F.struct("row", "role"), place, lambda of: F.filter(of, lambda y: y["row"].isNotNull()))
    together = claims.groupBy("doc_id", F.floor(F.col("ord") / TOGETHER).alias("__part")).agg(F.collect_list(F.struct(*claims.columns)).alias("__claims")).drop("__part")
    met = together.join(said, "doc_id", "left").join(placed, "doc_id", "left")
    ids = lambda x: F.filter(x["evidence_ids"], lambda i: i.isNotNull())
    cited = lambda x: F.transform(ids(x), lambda i: F.struct(i.alias("id"), F.coalesce(F.try_element_at("said", i), none).alias("texts"), F.try_element_at("placed", i).alias("cells")))
    out = met.select(F.inline(F.transform("__claims", lambda x: F.struct(x.alias("c"), cited(x).alias("__cited"), F.col("placed").isNotNull().alias("has_cells")))))
    cells_of = F.flatten(F.array_compact(F.col("__cited.cells")))
    out = out.select("c.*", "has_cells", F.coalesce("__cited", F.array().cast(out.schema["__cited"].dataType)).alias("__cited"))
    out = out.select(*claims.columns, "has_cells", "__cited", F.flatten("__cited.texts").alias("texts"), cells_of.alias("__cells"), item_index(F.col("path")).alias("__i"), item_field(F.col("path")).alias("__f"))
    told_by = F.struct(
        F.transform(F.filter("__cited", lambda x: F.size(x["texts"]) == 0), lambda x: x["id"]).alias("unknown"),
        "texts", F.array_join("texts", " ").alias("joined"), F.array_join("texts", "").alias("glued"),
        F.size("__cells").alias("mapped"), F.size(F.filter("__cells", lambda y: (y["row"] != F.col("__i")) | (y["role"] != F.col("__f")))).alias("mismatched"),
        "has_cells",
    )
    # made into a row of its own: a filter on these columns would otherwise be spelled out in terms of the arrays and search them anew for every mention
    out = out.select(*claims.columns, F.array(told_by).alias("__told")).select(*claims.columns, F.explode("__told").alias("__told"))
    return out.select(*claims.columns, "__told.*")


def verify(claims: DataFrame, headers: DataFrame, spans: DataFrame, cells: DataFrame, unicode: bool = False) -> DataFrame:
    """At most one issue per claim, by the first check that fails: doc_id, ord, code, path."""
    path = aliased(F.col("path"))
    known = claims.withColumn("path", path)
    numbered = known.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("ord"))).join(headers.hint("merge"), "doc_id")
    seen = with_evidence(numbered, spans, cells)
    in_table = (item_field(F.col("path")) != "") & F.col("has_cells") & ((F.col("mapped") == 0) | (F.col("mismatched") > 0))
    code = (
        F.when(F.col("nth") > 1, "DUPLICATE_CLAIM")
        .when(~allowed(F.col("path"), F.col("item_count"), F.col("delivery")), "UNSUPPORTED_CLAIM_PATH")
        .when(F.col("value").isNull(), F.lit(None))
        .when(F.size("unknown") > 0, "UNKNOWN_EVIDENCE_ID")
        .when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "MISSING_EVIDENCE")
        .when(in_table, "TABLE_CELL_MISMATCH")
        .when(~supported(F.col("path"), F.col("value"), F.col("joined"), F.col("glued"), unicode), "UNGROUNDED_VALUE")
    )
    # worked out in a projection, which is compiled, before the claims without an issue go
    return seen.select("doc_id", "ord", F.array(code).alias("__code"), "path").select("doc_id", "ord", F.explode(F.array_compact("__code")).alias("code"), "path")


def missing(claims: DataFrame, headers: DataFrame, item_fields: tuple[str, ...] = ITEM_FIELDS) -> DataFrame:
    """What a document needs and no claim gives (of several claims of a path the last counts): doc_id, code, path."""
    last = last_of(claims.withColumn("path", aliased(F.col("path"))), ["doc_id", "path"], ["ord"])
    given = last.filter(has_value(F.col("value"))).select("doc_id", "path", "value")
    texts = lambda names: F.array(*map(F.lit, names))
    none = F.array().cast("array<string>")
    items = F.when(F.col("item_count") > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.col("item_count") - 1, F.lit(0))), lambda i: F.array(*(F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{f}")) for f in item_fields))))).otherwise(none)
    address = F.when(F.col("delivery"), texts([f"debtor.delivery_address.{f}" for f in ("street", "zip", "city", "country")])).otherwise(none)
    # one row for each document: what is given and what is needed meet in it, and only gaps are rows again
    held = given.groupBy("doc_id").agg(F.collect_list("path").alias("paths"), F.count_if((F.col("path") == "payment.status") & (F.upper(F.trim("value")) == "PAID")).alias("paid"))
    met = headers.hint("merge").withColumn("headed", F.lit(True)).join(held.hint("merge"), "doc_id", "full_outer").withColumn("paths", F.coalesce("paths", none))
    gap = lambda code, path: F.struct(F.lit(code).alias("code"), path.alias("path"))
    only = lambda when, code, path: F.when(when, F.array(gap(code, F.lit(path)))).otherwise(F.array().cast("array<struct<code:string,path:string>>"))
    # paths are compared as a set difference, which is not a search for each
    gaps = F.when(F.col("headed"), F.transform(F.array_except(F.concat(texts(REQUIRED_PATHS), items, address), "paths"), lambda p: gap("MISSING_REQUIRED_CLAIM", p))).otherwise(F.array())
    every = F.concat(
        gaps,
        only(F.col("headed") & ~F.arrays_overlap("paths", texts(IDENTITY_PATHS)), "MISSING_IDENTITY_CLAIM", "debtor.company"),
        only(F.col("headed") & (F.col("item_count") == 0), "MISSING_ITEM_ROWS", "item_count"),
        only((F.col("paid") > 0) & ~F.array_contains("paths", "payment.payment_date"), "MISSING_CONDITIONAL_CLAIM", "payment.payment_date"),
    )
    return met.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")


def merge_trusted(claims: DataFrame, trusted: DataFrame) -> DataFrame:
    """Trusted claims in place of claims on the same path."""
    keyed = claims.withColumn("__key", aliased(F.col("path")))
    return override(keyed, trusted.withColumn("__key", F.col("path")), ["doc_id", "__key"]).drop("__key")


def merge_trusted_items(claims: DataFrame, trusted: DataFrame, counts: DataFrame) -> DataFrame:
    """As `merge_trusted` by the path as written, and without claims on items beyond the trusted count."""
    bounded = claims.join(counts.hint("merge"), "doc_id", "left").filter(F.coalesce(item_index(F.col("path")) < F.col("trusted_count"), F.lit(True))).drop("trusted_count")
    return override(bounded, trusted, ["doc_id", "path"])


def repair(original: DataFrame, repaired: DataFrame, issues: DataFrame) -> DataFrame:
    """Repaired claims for rejected paths only; a missing identity opens its three paths, a missing count all items."""
    # the paths that a document's issues open meet its claims, old and new, once: the issues are worked out once
    wider = F.when(F.col("path") == "debtor.company", F.array(*map(F.lit, IDENTITY_PATHS))).otherwise(F.array("path"))
    opened = issues.select("doc_id", wider.alias("paths"), (F.col("path") == "item_count").alias("counted")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("paths"))).alias("__open"), F.max("counted").alias("__counted")).hint("merge")
    new = last_of(repaired.withColumn("path", aliased(F.col("path"))), ["doc_id", "path"], ["ord"])
    every = original.select(*original.columns, aliased(F.col("path")).alias("__key"), F.lit(False).alias("__new")).unionByName(new.select(*original.columns, F.col("path").alias("__key"), F.lit(True).alias("__new")))
    # of the paths of items those that the repair has are open too where the count was missing
    item = F.coalesce(F.col("__counted"), F.lit(False)) & (item_field(F.col("__key")) != "")
    met = every.join(opened, "doc_id", "left")
    met = met.select(*every.columns, F.coalesce(F.array_contains("__open", F.col("__key")), F.lit(False)).alias("__in"), item.alias("__item"))
    met = met.withColumn("__in", F.col("__in") | F.coalesce(F.max(F.when(F.col("__item"), F.col("__new"))).over(Window.partitionBy("doc_id", "__key")), F.lit(False)))
    return met.filter(F.col("__in") == F.col("__new")).select(*original.columns)


def sanitize(claims: DataFrame, headers: DataFrame, issues: DataFrame) -> DataFrame:
    """Unresolved claims as explicit ambiguity: first claim of an allowed path counts, rejected values go, missing paths come in.

    issues has (doc_id, n, path, note), n being their order.
    """
    own = claims.select("doc_id", aliased(F.col("path")).alias("path"), "ord", "value", "evidence_ids", "ambiguity", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("note"))
    none = {c: F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("ord", "value", "evidence_ids", "ambiguity")}
    told = issues.select("doc_id", "path", *none.values(), F.col("n").cast("long").alias("n"), "note")
    # claims and issues meet by document, once; of claims the first of a path counts
    first = F.min_by(F.struct("value", "evidence_ids", "ambiguity"), F.col("ord"))
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("n", "note")))), lambda x: x["note"]), "; ")
    both = own.unionByName(told).repartition("doc_id").groupBy("doc_id", "path").agg(first.alias("c"), F.count("note").alias("notes"), notes.alias("note"))
    every = both.select("doc_id", "path", "c.*", F.when(F.col("notes") > 0, F.col("note")).alias("note")).join(headers.hint("merge"), "doc_id").filter(allowed(F.col("path"), F.col("item_count"), F.col("delivery")))
    rejected = F.col("note").isNotNull()
    return every.select("doc_id", "path", F.when(~rejected, F.col("value")).alias("value"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.when(rejected, F.col("note")).otherwise(F.col("ambiguity")).alias("ambiguity"))


def without_placeholders(claims: DataFrame) -> DataFrame:
    """Dashes and the like in optional fields are no values."""
    path = aliased(F.col("path"))
    optional = path.isin(*OPTIONAL_PATHS) | path.rlike(r"^debtor\.(billing_address|delivery_address)\.(email|telephone|additional_name|address_specification|district)$")
    blank = optional & F.lower(F.trim(F.coalesce("value", F.lit("")))).isin(*PLACEHOLDERS)
    return claims.withColumn("value", F.when(~blank, F.col("value")))


def no_delivery(spans: DataFrame) -> DataFrame:
    """Documents whose delivery heading is followed, within three lines, by words that say there is none."""
    ahead = Window.partitionBy("doc_id").orderBy("reading_order").rowsBetween(1, 3)
    near = spans.withColumn("near", F.array_join(F.collect_list("text").over(ahead), " "))
    head = F.col("text").rlike(r"(?i)\b(?:delivery|shipping)\s+address\b")
    says = F.col("near").rlike(r"(?i)(?:\bno\s+(?:delivery|shipping)\b|\bnot\s+(?:applicable|shipped)\b|\bbefore\s+shipment\b|\bn/?a\b|^\s*[—–-])")
    return near.filter(head & says).select("doc_id").distinct()


def without_proven_doubt(claims: DataFrame, spans: DataFrame, unicode: bool = False) -> DataFrame:
    """Status claims lose their ambiguity where the cited lines that are a status are all the claimed one."""
    doubtful = claims.filter("ambiguity IS NOT NULL AND value IS NOT NULL AND path = 'payment.status'")
    cited = doubtful.select("doc_id", "ord", "value", F.explode("evidence_ids").alias("id")).join(spans.select("doc_id", "id", "text"), ["doc_id", "id"])
    status = F.upper(T.source_text(F.col("text"), unicode))
    said = cited.filter(status.isin(*STATUSES)).groupBy("doc_id", "ord").agg(F.collect_set(status).alias("said"), F.first(F.upper(T.source_text(F.col("value"), unicode))).alias("want"))
    clear = said.filter(F.col("said") == F.array("want")).select("doc_id", "ord", F.lit(True).alias("clear"))
    return claims.join(clear, ["doc_id", "ord"], "left").withColumn("ambiguity", F.when(F.col("clear").isNull(), F.col("ambiguity"))).drop("clear")


def repair_context(spans: DataFrame, cited: DataFrame, before: int = 2, after: int = 2, fallback: int = 32) -> DataFrame:
    """Spans near cited ids in reading order; the first ones of a document where nothing is cited. cited has (doc_id, id)."""
    flagged = spans.join(cited.select("doc_id", "id").distinct().withColumn("hit", F.lit(1)), ["doc_id", "id"], "left")
    frame = Window.partitionBy("doc_id").orderBy("reading_order")
    # a span is kept if a hit lies from `after` places before it to `before` places behind it
    kept = flagged.withColumn("near", F.max("hit").over(frame.rowsBetween(-after, before))).withColumn("any", F.max("hit").over(Window.partitionBy("doc_id")))
    return kept.filter(F.col("near").isNotNull() | (F.col("any").isNull() & (F.col("reading_order") < fallback))).drop("hit", "near", "any")


#: Words to look for when a field is missing, by the start of its path; paths without a dot at the end of the list are whole.
SEARCH_TERMS = {
    "debtor.billing_address": ("billing address", "bill to", "addresses"),
    "debtor.delivery_address": ("delivery address", "ship to", "addresses"),
    "debtor.": ("customer", "contact", "company", "buyer"),
    "totals.total_net": ("net total", "total net", "subtotal"),
    "totals.total_vat": ("vat total", "total vat", "tax total"),
    "totals.total_gross": ("gross total", "total gross", "grand total"),
    "payment": ("payment", "paid", "status", "due date"),
    "order_date": ("order date", "date"),
    "external_reference": ("reference", "order no", "order number", "ref"),
    "currency": ("currency", " eur", " usd", " gbp", " jpy"),
    "item_count": ("items", "sku", "quantity", "qty"),
}
WHOLE_PATHS = ("order_date", "external_reference", "currency", "item_count")


def search_terms(path: Column) -> Column:
    """Words to look for when a field is missing: those of the longest start of its path in the table, else the path's own."""
    starts = F.array(*map(F.lit, sorted(SEARCH_TERMS, key=len, reverse=True)))
    fits = F.filter(starts, lambda s: F.when(s.isin(*WHOLE_PATHS), path == s).otherwise(path.startswith(s)))
    table = F.create_map(*(x for k, v in SEARCH_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, F.get(fits, F.lit(0))), F.filter(F.split(path, "[._]"), lambda x: F.length(x) > 2))


def repair_spans(spans: DataFrame, issues: DataFrame, cells: DataFrame, fallback: int = 32, unicode: bool = False) -> DataFrame:
    """Spans that a repair is shown: two on either side of cited ids; for issues that cite nothing the cells of the item's field, or
    from three before to eight behind each span with one of the field's words. The first ones of a document where that gives nothing.

    issues is (doc_id, path, evidence_ids), cells (doc_id, id, row, role); rows are numbered by position.
    """
    key = T.normalize_text(F.col("text"), unicode)
    # folding runs in Python and is done before the spans are gathered; plain lower-casing waits until a document has words to look for
    own = [c for c in spans.columns if c not in ("doc_id", "reading_order")]
    folded = [key.alias("__key")] if unicode else []
    pages = spans.select("doc_id", F.struct("reading_order", *own, *folded).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("spans"))
    told = issues.groupBy("doc_id").agg(F.collect_list(F.struct("path", "evidence_ids")).alias("issues"))
    grid = cells.groupBy("doc_id").agg(F.collect_list(F.struct("id", "row", "role")).alias("cells"))
    rows = pages.join(told.hint("merge"), "doc_id", "left").join(grid.hint("merge"), "doc_id", "left")
    return repair_rows(rows, fallback).select("doc_id", F.inline("shown")).select(*spans.columns)


def repair_rows(rows: DataFrame, fallback: int = 32) -> DataFrame:
    """(doc_id, shown): the spans of `repair_spans`, for documents in one row each: doc_id, spans in reading order, issues and cells as arrays.

    The places of hits, words and cells are spread to those around them and joined as sets, so that the work grows with the spans and not with their pairs.
    """
    nothing = lambda x: F.coalesce(F.size(x["evidence_ids"]), F.lit(0)) <= 0
    known = F.coalesce("issues", F.array().cast(rows.schema["issues"].dataType))
    rows = _once(rows, cited=F.array_distinct(F.flatten(F.transform(F.filter(known, lambda x: ~nothing(x)), lambda x: x["evidence_ids"]))), silent=F.array_distinct(F.transform(F.filter(known, nothing), lambda x: x["path"])))
    of_item = F.transform(F.filter("silent", lambda p: item_field(p) != ""), lambda p: F.struct(item_index(p).cast("long").alias("row"), item_field(p).alias("role")))
    terms = F.array_distinct(F.flatten(F.transform(F.filter("silent", lambda p: item_field(p) == ""), search_terms)))
    rows = _once(rows, asked=of_item, terms=terms)
    wanted = F.filter("cells", lambda c: F.exists("asked", lambda a: (a["row"] == c["row"]) & (a["role"] == c["role"])))
    rows = _once(rows, held=F.when(F.size("asked") > 0, F.transform(wanted, lambda c: c["id"])))
    last = F.size("spans") - 1
    text = lambda x: x["__key"] if "__key" in rows.schema["spans"].dataType.elementType.names else T.normalize_text(x["text"], False)
    places = lambda some, fits: F.when(some, F.array_compact(F.transform("spans", lambda x, i: F.when(fits(x), i)))).otherwise(F.array().cast("array<int>"))
    has_word = lambda x: F.exists(F.array(text(x)), lambda t: F.exists("terms", lambda w: t.contains(w)))
    rows = _once(rows, hits=places(F.size("cited") > 0, lambda x: F.array_contains("cited", x["id"])), words=places(F.size("terms") > 0, has_word), kept=places(F.coalesce(F.size("held") > 0, F.lit(False)), lambda x: F.array_contains("held", x["id"])))
    around = lambda at, before, behind: F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - before, F.lit(0)), F.least(i + behind, last))))
    rows = _once(rows, near=F.array_distinct(F.concat(around("hits", 2, 2), around("words", 3, 8), "kept")))
    shown = F.when(F.size("near") > 0, F.transform("near", lambda i: F.get("spans", i))).otherwise(F.slice("spans", 1, fallback))
    return rows.select("doc_id", shown.alias("shown"))


def without_proven_dates(claims: DataFrame, spans: DataFrame, unicode: bool = False) -> DataFrame:
    """Payment dates lose their ambiguity where one cited line alone holds the claimed date and one label of such dates stands by it."""
    from . import layout as L

    doubtful = claims.filter("ambiguity IS NOT NULL AND path = 'payment.payment_date'").select("doc_id", "ord", D.date_value(F.col("value")).alias("want"), F.explode("evidence_ids").alias("id")).filter("want IS NOT NULL").distinct()
    cited = doubtful.join(spans.select("doc_id", "id", "page", "text", "x0", "y0", "x1", "y1"), ["doc_id", "id"]).filter(F.array_contains(D.dates_in_text(F.col("text")), F.col("want")))
    alone = cited.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "ord"))).filter("n = 1")
    labels = spans.filter(T.label_text(F.col("text"), unicode).isin(*L.FIELD_LABELS["payment.payment_date"][0]))
    pairs = labels.alias("l").join(alone.alias("v"), L.PAGE).filter(L.nearness("total").isNotNull())
    clear = pairs.groupBy(F.col("v.ord").alias("ord"), "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("doc_id", "ord", F.lit(True).alias("clear"))
    mine = claims.join(clear, ["doc_id", "ord"], "left")
    return mine.withColumn("ambiguity", F.when(F.col("clear").isNull() | (F.col("path") != "payment.payment_date"), F.col("ambiguity"))).drop("clear")


def pivot_items(claims: DataFrame, fields: tuple[str, ...] = ITEM_FIELDS) -> DataFrame:
    """Item claims as one row per item; fields are fixed, so no pass over the data is needed to find them."""
    rows = claims.withColumn("item", item_index(F.col("path"))).filter("item IS NOT NULL")
    return rows.groupBy("doc_id", "item").pivot("field", list(fields)).agg(F.first("value")) if "field" in rows.columns else rows.withColumn("field", item_field(F.col("path"))).groupBy("doc_id", "item").pivot("field", list(fields)).agg(F.first("value"))


def ground(claims: DataFrame, spans: DataFrame, cells: DataFrame, required: Column, unicode: bool = False) -> DataFrame:
    """Issues of the authorising check: doc_id, ord, path, code, severity. A value may be doubtful and wrong at once.

    Unlike `verify`, evidence outside the table does not contradict an item path.
    """
    return ground_seen(with_evidence(claims, spans, cells), required, unicode)


def ground_seen(seen: DataFrame, required: Column, unicode: bool = False) -> DataFrame:
    """The issues of `ground` for claims that have what `with_evidence` adds."""
    there, doubt = has_value(F.col("value")), F.col("ambiguity").isNotNull()
    value, joined, glued, path = F.col("value"), F.col("joined"), F.col("glued"), F.col("path")
    holds = F.when(path == "payment.status", proven("status", value, joined, glued, unicode)).otherwise(supported(path, value, joined, glued, unicode))
    checked = there & (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0) & (F.size("unknown") == 0)
    found = F.array(
        F.when(doubt & (required | value.isNotNull()), F.struct(F.lit("AMBIGUOUS_FIELD").alias("code"), F.when(value.isNotNull(), "warning").otherwise("error").alias("severity"))),
        F.when(~there & required & ~doubt, F.struct(F.lit("MISSING_REQUIRED_VALUE").alias("code"), F.lit("error").alias("severity"))),
        F.when(there & (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0), F.struct(F.lit("MISSING_EVIDENCE").alias("code"), F.lit("error").alias("severity"))),
        F.when(there & (F.size("unknown") > 0), F.struct(F.lit("UNKNOWN_EVIDENCE_ID").alias("code"), F.lit("error").alias("severity"))),
        F.when(checked & (item_field(path) != "") & (F.col("mismatched") > 0), F.struct(F.lit("TABLE_CELL_MISMATCH").alias("code"), F.lit("error").alias("severity"))),
        F.when(checked & ~holds, F.struct(F.lit("UNGROUNDED_VALUE").alias("code"), F.lit("error").alias("severity"))),
    )
    return seen.select("doc_id", "ord", "path", F.explode(F.array_compact(found)).alias("x")).select("doc_id", "ord", "path", "x.code", "x.severity")


def address_parts(addresses: DataFrame, unicode: bool = False) -> DataFrame:
    """Postal code and city of combined lines: doc_id, zip, city, code. Addresses have zip, city, country, lines (cited texts).

    One pair that agrees with both fields replaces them; several pairs or a field that disagrees give an issue.
    """
    pairs = F.array_compact(F.concat(F.array(T.postal_city_in(F.col("zip"), F.col("country"), unicode), T.postal_city_in(F.col("city"), F.col("country"), unicode)), F.transform("lines", lambda t: T.postal_city_in(t, F.col("country"), unicode))))
    rows = addresses.withColumn("pairs", F.array_distinct(pairs))
    one = F.get(F.col("pairs"), F.lit(0))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fits = (blank("zip") | T.component_matches(F.col("zip"), one["postal"], one["city"], unicode)) & (blank("city") | T.component_matches(F.col("city"), one["city"], one["postal"], unicode))
    use = (F.size("pairs") == 1) & fits & ~(blank("zip") & blank("city"))
    code = F.when(F.size("pairs") > 1, "CONFLICTING_ADDRESS_COMPONENTS").when((F.size("pairs") == 1) & ~fits, "CONFLICTING_ADDRESS_COMPONENTS")
    return rows.select("doc_id", F.when(use, one["postal"]).otherwise(F.col("zip")).alias("zip"), F.when(use, one["city"]).otherwise(F.col("city")).alias("city"), code.alias("code"))

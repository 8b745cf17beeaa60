"""Rules over recomputed orders: each gives issues (doc_id, code, path, message, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

ERROR, WARNING = "error", "warning"
SUPPORTED_STATUS = ("PAID", "UNPAID")


def issue(rows: DataFrame, when: Column, code: str, path: Column | str, message: Column | str, severity: str = ERROR) -> DataFrame:
    """One issue for each row for which the condition holds."""
    at, said = (F.lit(x) if isinstance(x, str) else x for x in (path, message))
    return rows.filter(when).select("doc_id", F.lit(code).alias("code"), at.alias("path"), said.alias("message"), F.lit(severity).alias("severity"))


def together(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def item_path(index: Column, field: str) -> Column:
    return F.concat(F.lit("items["), index.cast("string"), F.lit(f"].{field}"))


def payment_issues(orders: DataFrame) -> DataFrame:
    """Paid needs a date, unpaid must have none, other statuses are not supported."""
    status, date = F.col("status"), F.col("payment_date")
    return together(
        issue(orders, (status == "PAID") & date.isNull(), "PAYMENT_DATE_REQUIRED", "payment.payment_date", "PAID needs a payment date"),
        issue(orders, (status == "UNPAID") & date.isNotNull(), "PAYMENT_DATE_CONFLICT", "payment.payment_date", "UNPAID has a payment date"),
        issue(orders, ~status.isin(*SUPPORTED_STATUS), "UNSUPPORTED_PAYMENT_STATUS", "payment.status", "status cannot be applied"),
    )


def line_issues(lines: DataFrame) -> DataFrame:
    """Printed line totals that differ from the recomputed amount by more than a cent."""
    return issue(lines, ~N.within_tolerance(F.col("net"), F.col("source_total")), "LINE_TOTAL_MISMATCH", item_path(F.col("pos"), "source_total"), "line total differs")


def totals(lines: DataFrame) -> DataFrame:
    """Net, tax and gross of each document: rounded lines are summed, never the other way round."""
    sums = lines.groupBy("doc_id").agg(F.sum("net").cast("decimal(18,2)").alias("total_net"), F.sum("line_vat").cast("decimal(18,2)").alias("total_vat"), F.count(F.lit(1)).alias("n_items"))
    return sums.withColumn("total_gross", (F.col("total_net") + F.col("total_vat")).cast("decimal(18,2)"))


def total_issues(found: DataFrame, printed: DataFrame) -> DataFrame:
    """Printed totals that differ from the sums; printed has doc_id and the three totals."""
    names = ("total_net", "total_vat", "total_gross")
    both = found.select("doc_id", *names).join(printed.select("doc_id", *(F.col(n).alias(f"printed_{n}") for n in names)), "doc_id")
    kinds = F.explode(F.array(*(F.struct(F.lit(f"totals.{n}").alias("path"), F.col(n).alias("a"), F.col(f"printed_{n}").alias("b")) for n in names)))
    long = both.select("doc_id", kinds.alias("t")).select("doc_id", "t.*")
    return issue(long, ~N.within_tolerance(F.col("a"), F.col("b")), "ORDER_TOTAL_MISMATCH", F.col("path"), "total differs")


def confidence_issues(evidence: DataFrame) -> DataFrame:
    """Low confidence is an error, moderate a warning; evidence has doc_id, path, confidence."""
    c = F.col("confidence")
    return together(
        issue(evidence, c < 0.75, "LOW_OCR_CONFIDENCE", F.col("path"), "low confidence"),
        issue(evidence, (c >= 0.75) & (c < 0.90), "MODERATE_OCR_CONFIDENCE", F.col("path"), "moderate confidence", WARNING),
    )


#: Warnings of an image's quality by what falls short.
IMAGE_LIMITS = (("width", 800, "LOW_RESOLUTION"), ("blur", 75, "BLURRED"), ("contrast", 32, "LOW_CONTRAST"))


def image_issues(quality: DataFrame) -> DataFrame:
    return together(*(issue(quality, F.col(c) < limit, "IMAGE_QUALITY_WARNING", "image", name, WARNING) for c, limit, name in IMAGE_LIMITS))


#: Paths that need evidence.
CRITICAL_FIELDS = ("order_date", "external_reference", "debtor.billing_address.zip", "debtor.billing_address.city", "payment.method", "payment.status", "totals.total_net", "totals.total_vat", "totals.total_gross")
CRITICAL_ITEM_FIELDS = ("sku", "quantity", "unit_net_price", "vat_percent", "discount_percent", "source_total")


def critical_paths(orders: DataFrame) -> DataFrame:
    """(doc_id, critical): the paths that need evidence, as an array; orders has doc_id, n_items, status."""
    fixed = F.array(*map(F.lit, CRITICAL_FIELDS))
    item = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_items") - 1, F.lit(0))), lambda i: F.array(*(item_path(i, f) for f in CRITICAL_ITEM_FIELDS))))
    date = F.when(F.col("status") == "PAID", F.array(F.lit("payment.payment_date"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(fixed, date, F.when(F.col("n_items") > 0, item).otherwise(F.array().cast("array<string>")))
    return orders.select("doc_id", every.alias("critical"))


def missing_evidence(critical: DataFrame, grounded: DataFrame) -> DataFrame:
    """One issue for each document with critical paths that no evidence grounds; the paths sorted. grounded is (doc_id, path)."""
    lists = grounded.groupBy("doc_id").agg(F.collect_set("path").alias("grounded"))
    return ungrounded(critical.join(lists.hint("merge"), "doc_id", "left"))


def ungrounded(rows: DataFrame) -> DataFrame:
    """The issues of `missing_evidence` where both kinds of paths are in the document's row: (doc_id, critical, grounded)."""
    gaps = F.array_except("critical", F.coalesce("grounded", F.array().cast("array<string>")))
    left = rows.select("doc_id", F.inline(F.array(F.struct(F.sort_array(gaps).alias("gaps"))))).filter(F.size("gaps") > 0)
    return left.select("doc_id", F.lit("MISSING_CRITICAL_EVIDENCE").alias("code"), F.lit("evidence").alias("path"), F.array_join("gaps", ", ").alias("message"), F.lit(ERROR).alias("severity"))


def whole_order_issues(orders: DataFrame) -> DataFrame:
    """Orders without items or without anybody to bill; orders has doc_id, n_items, company, first_name, last_name."""
    nobody = (F.coalesce(F.col("company"), F.lit("")) == "") & (F.coalesce(F.col("first_name"), F.lit("")) == "") & (F.coalesce(F.col("last_name"), F.lit("")) == "")
    return together(
        issue(orders, F.coalesce(F.col("n_items"), F.lit(0)) == 0, "MISSING_ORDER_ITEMS", "items", "no items"),
        issue(orders, nobody, "MISSING_DEBTOR_IDENTITY", "debtor", "no company or name"),
    )


def name_split_issues(names: DataFrame, spans: DataFrame, unicode: bool = False) -> DataFrame:
    """First and last names that share evidence and do not stand apart in it.

    names has doc_id, first_name, first_ids, last_name, last_ids. Where the shared text lacks one of the two, other evidence holds it.
    """
    asked = names.filter("first_name <> '' AND last_name <> ''").select("doc_id", "first_name", "last_name", F.array_intersect("first_ids", "last_ids").alias("shared")).filter(F.size("shared") > 0)
    cited = asked.select("doc_id", F.posexplode("shared").alias("pos", "id")).join(spans.select("doc_id", "id", "text"), ["doc_id", "id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    source = cited.groupBy("doc_id").agg(joined.alias("source"))
    key = lambda c: T.source_text(F.col(c), unicode)
    both = asked.join(source, "doc_id").select("doc_id", key("source").alias("source"), key("first_name").alias("first"), key("last_name").alias("last"))
    wrong = F.col("source").contains(F.col("first")) & F.col("source").contains(F.col("last")) & ~T.disjoint_occurrences(F.col("source"), F.col("first"), F.col("last"))
    return issue(both, wrong, "INVALID_PERSON_NAME_SPLIT", "debtor.first_name", "first and last name overlap")


def identifier_review(quality: DataFrame) -> DataFrame:
    """Item numbers of images of low resolution have to be looked at; quality has doc_id, width, n_items."""
    low = quality.filter(F.col("width") < dict((c, limit) for c, limit, _ in IMAGE_LIMITS)["width"]).filter("n_items > 0")
    items = low.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_items").cast("int") - 1)).alias("pos"))
    return issue(items, F.lit(True), "LOW_RESOLUTION_IDENTIFIER_REVIEW", item_path(F.col("pos"), "sku"), "low resolution", WARNING)


def parser_issues(orders: DataFrame) -> DataFrame:
    """Orders read by fixed coordinates may be looked at, but authorise nothing."""
    return issue(orders, F.lit(True), "LEGACY_COORDINATE_PARSER", "parser", "diagnostics only", WARNING)


def ambiguity_issues(refusals: DataFrame) -> DataFrame:
    """Runs that stopped because several records fit; refusals has doc_id, message."""
    return issue(refusals, F.lit(True), "WORKFLOW_AMBIGUITY", "workflow", F.col("message"))


def coded(issues: DataFrame) -> DataFrame:
    """Issues with their defaults: a code of no kind, an error."""
    return issues.withColumn("code", F.coalesce("code", F.lit("VALIDATION_ISSUE"))).withColumn("severity", F.coalesce("severity", F.lit(ERROR)))


def error_details(issues: DataFrame) -> DataFrame:
    """What is said of each document with an error: all its issues as path and message, in the order of n."""
    one = F.struct("n", F.concat_ws(": ", "path", "message").alias("text"))
    said = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.max(F.col("severity") == ERROR).alias("failed"))
    return said.filter("failed").select("doc_id", F.array_join(F.transform("all", lambda x: x["text"]), "; ").alias("details"))


def report(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """valid (no error), requires_review (any issue) and counts, for every document."""
    sums = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_issues"), F.count_if(F.col("severity") == ERROR).alias("n_errors"))
    every = documents.select("doc_id").join(sums, "doc_id", "left").na.fill(0, ["n_issues", "n_errors"])
    return every.withColumn("valid", F.col("n_errors") == 0).withColumn("requires_review", F.col("n_issues") > 0)


def payload(issues: DataFrame) -> DataFrame:
    """The issues of a document as one line, by code and path."""
    one = F.concat_ws("|", "code", "path", "severity")
    return issues.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "; ").alias("payload"), F.count(F.lit(1)).alias("n_issues"))


def summary(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, payload): whether a document is valid and needs review, and its issues in the order of n, as one JSON text. Documents without issues are valid."""
    one = F.struct("n", F.struct("code", "path", "severity", "message").alias("issue"))
    own = issues.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["issue"]).alias("issues"), F.max(F.col("severity") == ERROR).alias("failed"))
    every = documents.select("doc_id").join(own, "doc_id", "left")
    none = F.array().cast(own.schema["issues"].dataType)
    body = F.struct((~F.coalesce("failed", F.lit(False))).alias("valid"), F.col("issues").isNotNull().alias("requires_review"), F.coalesce("issues", none).alias("issues"))
    return every.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))

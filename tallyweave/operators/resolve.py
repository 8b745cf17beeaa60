"""Entity resolution against master data: none creates, one is used, several or a conflict go to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import containment
from .extraction import staged
from .sequence import numbered

#: Codes of payment methods that may be created.
PAYMENT_CODES = {"bank transfer": "Credit transfer", "credit card": "Credit card", "sepa direct debit": "SEPA direct debit"}


def outcome(n: Column, conflict: Column | None = None) -> Column:
    base = F.when(n > 1, "review").when(n == 1, "use").otherwise("create")
    return base if conflict is None else F.when(conflict, "review").otherwise(base)


def products(items: DataFrame, master: DataFrame, unicode: bool = False) -> DataFrame:
    """items (…, sku) against master (record_id, sku): adds n_matches, record_id if there is one, outcome.

    Matches are counted in the master once per key, so an item row joins at most one row.
    """
    keyed = master.withColumn("key", T.normalize_text(F.col("sku"), unicode)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("id"))
    found = items.withColumn("key", T.normalize_text(F.col("sku"), unicode)).join(keyed, "key", "left")
    n = F.coalesce("n", F.lit(0))
    return found.withColumn("n_matches", n).withColumn("record_id", F.when(n == 1, F.col("id"))).withColumn("outcome", outcome(n)).drop("key", "n", "id")


def vats(wanted: DataFrame, master: DataFrame) -> DataFrame:
    """wanted (value, label) against master (record_id, name, value, code): used if just one record holds the label and all else agrees."""
    name = lambda c: F.lower(F.trim(c))
    m = master.select(F.col("record_id").alias("id"), name("name").alias("key"), F.col("value").alias("v"), name("code").alias("code"))
    exact = (F.col("v") == F.col("value")) & (F.col("code") == "s")
    sums = wanted.withColumn("key", name("label")).join(m, "key", "left").groupBy("value", "label").agg(F.count("id").alias("n"), F.count_if(exact).alias("n_exact"), F.min(F.when(exact, F.col("id"))).alias("record_id"))
    state = F.when(F.col("n") > 1, "review").when(F.col("n_exact") == 1, "use").when(F.col("n") == 1, "review").otherwise("create")
    return sums.select("value", "label", F.col("n").alias("n_matches"), F.when(state == "use", F.col("record_id")).alias("record_id"), state.alias("outcome"))


def payment_methods(wanted: DataFrame, master: DataFrame, unicode: bool = False) -> DataFrame:
    """wanted (method) against master (record_id, name, description, code): conflicts of text or code go to review, unknown codes too."""
    key = lambda c: T.normalize_text(F.col(c), unicode)
    code = F.lit(None).cast("string")
    for name, value in PAYMENT_CODES.items():
        code = F.when(F.col("key") == name, value).otherwise(code)
    asked = wanted.select("method").distinct().withColumn("key", key("method")).withColumn("expected", code)
    m = master.select(F.col("record_id").alias("id"), key("name").alias("key"), key("description").alias("description"), key("code").alias("code"))
    sums = asked.join(m, "key", "left").groupBy("method", "key", "expected").agg(F.count("id").alias("n"), F.min("id").alias("id"), F.min("description").alias("description"), F.min("code").alias("code"))
    differs = (F.col("n") == 1) & ((F.col("description") != F.col("key")) | (F.col("expected").isNotNull() & (F.col("code") != F.lower("expected"))))
    state = F.when(F.col("n") > 1, "review").when(differs, "review").when(F.col("n") == 1, "use").when(F.col("expected").isNull(), "review").otherwise("create")
    return sums.select("method", "expected", F.col("n").alias("n_matches"), state.alias("outcome"))


def debtor_match(e: str, a: str, unicode: bool = False) -> Column:
    """Same identity (company, or first and last name), no part that contradicts, same postal code and city."""
    key = lambda side, c: T.normalize_text(F.col(f"{side}.{c}"), unicode)
    same = lambda c: key(e, c) == key(a, c)
    blank = lambda side, c: key(side, c) == ""
    agrees = lambda c: blank(e, c) | blank(a, c) | same(c)
    person = (~blank(e, "first_name") | ~blank(e, "last_name")) & same("first_name") & same("last_name")
    return ((~blank(e, "company") & same("company")) | person) & agrees("company") & agrees("first_name") & agrees("last_name") & place_match(e, a, unicode)


def place_match(e: str, a: str, unicode: bool = False) -> Column:
    postal = lambda side: T.normalize_postal_code(F.col(f"{side}.zip"), unicode)
    return (postal(e) == postal(a)) & (T.normalize_text(F.col(f"{e}.city"), unicode) == T.normalize_text(F.col(f"{a}.city"), unicode))


def debtors(expected: DataFrame, master: DataFrame, unicode: bool = False) -> DataFrame:
    """expected (doc_id, company, first_name, last_name, zip, city) against master (record_id, same fields).

    Candidates meet on equal company or equal full name, which are equality keys; the rest is residual. The
    same person elsewhere, and no match, is a conflict.
    """
    key = lambda c: T.normalize_text(F.col(c), unicode)
    full = F.concat_ws("|", key("first_name"), key("last_name"))
    keys = lambda: F.explode(F.array_distinct(F.array(F.concat(F.lit("c:"), key("company")), F.concat(F.lit("p:"), full)))).alias("k")
    some = lambda df: df.filter(~F.col("k").isin("c:", "p:|"))
    e, a = some(expected.select("*", keys())), some(master.select("*", keys()))
    person = (T.normalize_text(F.col("e.first_name"), unicode) == T.normalize_text(F.col("a.first_name"), unicode)) & (T.normalize_text(F.col("e.last_name"), unicode) == T.normalize_text(F.col("a.last_name"), unicode))
    pairs = e.alias("e").join(a.alias("a"), F.col("e.k") == F.col("a.k")).select(F.col("e.doc_id").alias("doc_id"), F.col("a.record_id").alias("id"), debtor_match("e", "a", unicode).alias("match"), person.alias("person")).distinct()
    sums = pairs.groupBy("doc_id").agg(F.count_if("match").alias("n"), F.count_if(F.col("person") & ~F.col("match")).alias("elsewhere"), F.max(F.when(F.col("match"), F.col("id"))).alias("id"))
    found = expected.select("doc_id").join(sums, "doc_id", "left").na.fill(0, ["n", "elsewhere"])
    conflict = (F.col("elsewhere") > 0) & (F.col("n") == 0)
    return found.select("doc_id", F.col("n").alias("n_matches"), F.when(F.col("n") == 1, F.col("id")).alias("record_id"), outcome(F.col("n"), conflict).alias("outcome"))


def addresses_match(e: str, a: str, unicode: bool = False) -> Column:
    same = lambda c: T.normalize_text(F.col(f"{e}.{c}"), unicode) == T.normalize_text(F.col(f"{a}.{c}"), unicode)
    return same("street") & same("country") & place_match(e, a, unicode)


def created(wanted: DataFrame, existing: DataFrame, key: str, prefix: str) -> DataFrame:
    """New records for keys that the master lacks, numbered on from its size in the order of the keys: record_id, key."""
    new = wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(existing.select(key), key, "left_anti")
    made = numbered(new, [key], "number", existing.count() + 1)
    return made.select(F.concat(F.lit(f"{prefix}-"), F.col("number").cast("string")).alias("record_id"), key)


#: Most queries of a substring search that are broadcast.
COPIED = 1_000


def substring_search(queries: DataFrame, master: DataFrame, fields: list[str]) -> DataFrame:
    """Records whose joined text contains the query, case-blind. queries has (query); up to COPIED of them are copied to the records, more meet them through an index of grams. None is left out."""
    text = F.lower(F.concat_ws(" ", *fields))
    asked = queries.select("query").filter("query IS NOT NULL").distinct()
    if asked.limit(COPIED + 1).count() <= COPIED:
        return master.withColumn("__text", text).join(F.broadcast(asked), F.expr("contains(__text, lower(trim(query)))")).drop("__text")
    rows = staged(master.withColumns({"__text": text, "__row": F.monotonically_increasing_id()}), "records")
    keyed = asked.withColumn("__key", F.lower(F.trim("query")))
    patterns = keyed.select("__key").distinct()
    found = containment.pairs(rows.select(F.col("__row").alias("t"), F.col("__text").alias("text")), patterns.select(F.col("__key").alias("p"), F.col("__key").alias("pattern")))
    return rows.join(found.withColumnRenamed("t", "__row").hint("merge"), "__row").join(keyed.withColumnRenamed("__key", "p").hint("merge"), "p").drop("p", "__text", "__row")


def scored_search(query: Column, master: DataFrame, unicode: bool = False) -> DataFrame:
    """The one best record of a search: company 3, full name 2, a part or the start of the company 1; ties to the larger id."""
    q = T.normalize_text(query, unicode)
    key = lambda c: T.normalize_text(F.col(c), unicode)
    full = T.normalize_text(F.concat_ws(" ", "first_name", "last_name"), unicode)
    both = (key("first_name") != "") & (key("last_name") != "")
    score = F.when((key("company") != "") & (key("company") == q), 3).when(both & (full == q), 2).when((key("first_name") == q) | (key("last_name") == q), 1).when((key("company") != "") & key("company").startswith(q), 1).otherwise(0)
    return master.withColumn("score", score).filter("score > 0")

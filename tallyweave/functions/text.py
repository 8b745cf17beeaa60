"""Text normalisation as column expressions.

Unicode compatibility folding has no built-in form in Spark, so `folded` runs it in an Arrow UDF; all
the rest stays in the JVM. With ``unicode=False`` a plain lower-casing takes its place, which gives the
same result for ASCII text without leaving generated code.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def folded(c: Column, unicode: bool = True) -> Column:
    return _nfkc_casefold(c) if unicode else F.lower(c)


def compatible(c: Column, unicode: bool = True) -> Column:
    return _nfkc(c) if unicode else c


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column, unicode: bool = True) -> Column:
    """Comparison key of a name: folded, collapsed, null as empty."""
    return collapsed(folded(F.coalesce(c, F.lit("")), unicode))


def normalize_postal_code(c: Column, unicode: bool = True) -> Column:
    return F.regexp_replace(normalize_text(c, unicode), "[^0-9a-z]", "")


def label_text(c: Column, unicode: bool = True) -> Column:
    """Key of a printed label: folded, bracketed parts dropped, other characters than words as spaces."""
    bare = F.regexp_replace(folded(c, unicode), r"\([^)]*\)", "")
    return collapsed(F.regexp_replace(bare, r"(?U)[^\w]+", " "))


def header_text(c: Column, unicode: bool = True) -> Column:
    """As `label_text`, but # counts as a word: it heads row numbers."""
    bare = F.regexp_replace(folded(c, unicode), r"\([^)]*\)", "")
    return collapsed(F.regexp_replace(bare, r"(?U)[^\w#]+", " "))


def source_text(c: Column, unicode: bool = True) -> Column:
    """Printed text for comparison, case kept."""
    return collapsed(compatible(c, unicode))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def line_id(n: Column) -> Column:
    """Id of the nth recognised line, with four digits at least."""
    return F.concat(F.lit("ocr_"), F.when(n < 1000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))


def bare(c: Column) -> Column:
    """Without spaces and commas at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "^[ ,]+", ""), "[ ,]+$", "")


def contact_name(c: Column) -> Column:
    """(first, last) of a printed name; a single word is the last name."""
    parts = F.split(F.trim(c), r"\s+", 2)
    return F.struct(
        F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).alias("first_name"),
        F.when(F.trim(c) != "", F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))).alias("last_name"),
    )


#: Shapes of a line that holds a postal code and a city, tried in this order.
POSTAL_CITY = (
    (r"(?i)^(\d{4,6}(?:[- ]\d{3,4})?)\s+(.+)$", 1, 2),
    (r"(?i)^(.+?)[,\s]+(\d{4,6}(?:-\d{3,4})?)$", 2, 1),
    (r"(?i)^(.+?)[,\s]+([A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})$", 2, 1),
    (r"(?i)^(.+?)[,\s]+([A-Z]\d[A-Z]\s?\d[A-Z]\d)$", 2, 1),
)


def postal_city(c: Column, unicode: bool = False) -> Column:
    """(postal, city) if the shapes that fit give one pair, else null."""
    source = bare(source_text(c, unicode))

    def pair(shape: tuple[str, int, int]) -> Column:
        pattern, p, q = shape
        postal, city = F.upper(F.trim(F.regexp_extract(source, pattern, p))), bare(F.regexp_extract(source, pattern, q))
        good = source.rlike(pattern) & postal.rlike("[0-9]") & city.rlike(r"\p{L}")
        return F.when(good, F.struct(postal.alias("postal"), city.alias("city")))

    found = F.array_distinct(F.array_compact(F.array(*map(pair, POSTAL_CITY))))
    return F.get(F.get(F.filter(F.array(found), lambda pairs: F.size(pairs) == 1), F.lit(0)), F.lit(0))


#: Countries by name and code, and the postal line of each group; the first group that lists a country decides.
COUNTRY_POSTAL = (
    (("de", "deutschland", "germany"), r"(?i)^(\d{5})\s+(.+)$", 1),
    (("at", "austria", "be", "belgium", "belgique", "belgie", "belgië", "ch", "danmark", "denmark", "hu", "hungary", "no", "norge", "norway", "österreich", "schweiz", "suisse", "svizzera", "switzerland"), r"(?i)^(\d{4})\s+(.+)$", 1),
    (("es", "espana", "españa", "fi", "finland", "fr", "france", "it", "italia", "italy", "se", "spain", "sweden", "sverige"), r"(?i)^(\d{3}\s?\d{2})\s+(.+)$", 1),
    (("nl", "netherlands", "nederland"), r"(?i)^(\d{4}\s?[A-Z]{2})\s+(.+)$", 1),
    (("pl", "poland", "polska"), r"(?i)^(\d{2}-\d{3})\s+(.+)$", 1),
    (("cz", "czech republic", "czechia", "sk", "slovakia", "slovensko"), r"(?i)^(\d{3}\s?\d{2})\s+(.+)$", 1),
    (("jp", "japan", "日本"), r"(?i)^(\d{3}-\d{4})\s+(.+)$", 1),
    (("us", "usa", "united states", "united states of america"), r"(?i)^(.+?)[,\s]+(\d{5}(?:-\d{4})?)$", 2),
    (("ca", "canada"), r"(?i)^(.+?)[,\s]+([A-Z]\d[A-Z]\s?\d[A-Z]\d)$", 2),
    (("england", "gb", "great britain", "uk", "united kingdom"), r"(?i)^(.+?)[,\s]+([A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})$", 2),
    (("au", "australia", "new zealand", "nz"), r"(?i)^(.+?)[,\s]+(\d{4})$", 2),
    (("in", "india"), r"(?i)^(.+?)[,\s]+(\d{6})$", 2),
    (("br", "brazil"), r"(?i)^(.+?)[,\s]+(\d{5}-\d{3})$", 2),
)


def postal_city_of(source: Column, country: Column) -> Column:
    """(postal, city) of a bare line in the form of its country, else null; both are normalised already."""
    shapes: dict[str, tuple[str, int]] = {}
    for countries, pattern, p in COUNTRY_POSTAL:
        for name in countries:
            shapes.setdefault(name, (pattern, p))
    # the shape is looked up, so that the line is matched once however many countries there are
    table = F.create_map(*(x for name, (pattern, p) in shapes.items() for x in (F.lit(name), F.struct(F.lit(pattern).alias("pattern"), F.lit(p).alias("at")))))
    shape = F.try_element_at(table, country)
    part = lambda n: F.call_function("regexp_extract", source, shape["pattern"], n)
    postal, city = F.upper(collapsed(part(shape["at"]))), bare(collapsed(part(3 - shape["at"])))
    return F.when(postal.rlike("[0-9]") & city.rlike(r"\p{L}"), F.struct(postal.alias("postal"), city.alias("city")))


def postal_city_in(c: Column, country: Column, unicode: bool = False) -> Column:
    """(postal, city) of a line in the form of its country, else null."""
    return postal_city_of(bare(source_text(c, unicode)), normalize_text(country, unicode))


def component_matches(value: Column, component: Column, other: Column, unicode: bool = False) -> Column:
    """Whether a separate address part agrees with a combined line: blank, equal, or inside one of its spellings."""
    v = bare(normalize_text(value, unicode))
    a, b = normalize_text(component, unicode), normalize_text(other, unicode)
    spellings = F.array(F.concat_ws(" ", a, b), F.concat_ws(" ", b, a), F.concat_ws(", ", a, b), F.concat_ws(", ", b, a))
    return (v == "") | (v == bare(a)) | F.exists(spellings, lambda s: bare(s).contains(v))


def disjoint_occurrences(source: Column, first: Column, last: Column) -> Column:
    """Whether both parts occur in the text at places that do not overlap."""
    ends = lambda part: F.instr(source, part) + F.length(part)
    starts = lambda part: F.length(source) - F.instr(F.reverse(source), F.reverse(part)) - F.length(part) + 2
    # the earliest end of one against the latest start of the other
    both = (F.length(first) > 0) & (F.length(last) > 0) & source.contains(first) & source.contains(last)
    return both & ((ends(first) <= starts(last)) | (ends(last) <= starts(first)))

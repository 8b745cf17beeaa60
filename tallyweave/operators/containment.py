"""Which texts contain which patterns, by an n-gram index: equality joins only, for any number of either.

Every pattern is looked up by its rarest gram of up to SIZE characters, and what is found is verified on the text. Patterns of
SIZE characters at most are their own gram. An empty pattern is in every text. Nothing is left out, however frequent a gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def _grams(c: Column, n: int) -> Column:
    """Different runs of n characters."""
    if n == 0:
        return F.array(F.lit(""))
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(places, lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def pairs(texts: DataFrame, patterns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, p): texts is (keys, t, text), patterns (keys, p, pattern), both with one row for each of t and p of a key; null texts and patterns match nothing."""
    texts, patterns = texts.filter("text IS NOT NULL"), patterns.filter("pattern IS NOT NULL")
    # at most four sizes come to the driver: texts give grams of the sizes that are asked for
    sizes = sorted(r.n for r in patterns.select(F.least(F.length("pattern"), F.lit(SIZE)).alias("n")).distinct().collect())
    if not sizes:
        return texts.limit(0).select(*keys, "t", F.lit(None).cast(patterns.schema["p"].dataType).alias("p"))
    on = [*keys, "gram"]
    of_text = texts.select(*keys, "t", F.explode(F.concat(*(_grams(F.col("text"), n) for n in sizes))).alias("gram"))
    own = F.lit(None)
    for n in sizes:
        own = F.when(F.least(F.length("pattern"), F.lit(SIZE)) == n, _grams(F.col("pattern"), n)).otherwise(own)
    of_pattern = patterns.select(*keys, "p", own.alias("grams")).select(*keys, "p", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    # counted before anything is joined: what moves are counts. No side is broadcast, as exploded rows are not in Spark's estimates
    frequency = of_text.groupBy(*on).agg(F.count(F.lit(1)).alias("texts"))
    # a pattern with a gram that no text has is in none
    rarest = of_pattern.join(frequency.hint("merge"), on).groupBy(*keys, "p", "n").agg(F.count(F.lit(1)).alias("found"), F.min_by("gram", F.struct("texts", "gram")).alias("gram")).filter("found = n")
    met = of_text.join(rarest.select(*on, "p").hint("merge"), on)
    whole = met.select(*keys, "t", "p").join(texts.select(*keys, "t", "text").hint("merge"), [*keys, "t"]).join(patterns.select(*keys, "p", "pattern").hint("merge"), [*keys, "p"])
    return whole.filter(F.contains("text", "pattern")).select(*keys, "t", "p")

"""Unique or refuse: a value counts only if exactly one candidate wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_best(candidates: DataFrame, keys: list[str], score: list[Column | str]) -> DataFrame:
    """The candidate of least score of each group, where no other shares that score.

    The rank filter comes first, so that Spark keeps only the best of each group before and after the
    exchange; ties are counted on what is left.
    """
    best = candidates.withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(*score))).filter("__rank = 1")
    return best.withColumn("__ties", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__ties = 1").drop("__rank", "__ties")


def exactly_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that are alone in their group."""
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n = 1").drop("__n")


def cardinality(n: Column) -> Column:
    """0, 1 or many as an outcome."""
    return F.when(n == 0, "create").when(n == 1, "use").otherwise("review")


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in an order that should be total."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_of(rows, keys, [F.col(c).desc() for c in order])


def gathered(rows: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """The rows of each key as one array of structs, to be joined by that key alone.

    Rows that are parted by the key meet it where they are; a join by further keys would move both sides. The hint keeps
    tables of the size of the input off the driver: what exploded rows come to is not in Spark's estimate.
    """
    return rows.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias(name)).hint("merge")


def marked_in(rows: DataFrame, others: DataFrame, keys: list[str], name: str = "__held") -> DataFrame:
    """rows with `name`, whether the first key's array of second keys has theirs; null keys are in no array."""
    first, second = keys
    held = others.groupBy(first).agg(F.collect_set(second).alias("__set")).hint("merge")
    met = rows.join(held, first, "left")
    return met.withColumn(name, F.coalesce(F.array_contains("__set", F.col(second)), F.lit(False))).drop("__set")


def not_in(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Set difference by key."""
    if len(keys) == 2:
        return marked_in(rows, others, keys).filter("NOT __held").drop("__held")
    return rows.join(others.select(*keys).hint("merge"), keys, "left_anti")


def within(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose two keys others have."""
    return marked_in(rows, others, keys).filter("__held").drop("__held")


def override(base: DataFrame, trusted: DataFrame, keys: list[str]) -> DataFrame:
    """Trusted rows, and the base rows whose key no trusted row has."""
    return not_in(base, trusted, keys).unionByName(trusted)

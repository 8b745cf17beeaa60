"""Consecutive numbers in a given order, at any size: ranges are sorted apart and go on from the counts of those before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extraction import staged


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """rows with a number from start on, in ascending order (nulls first). Rows that are equal in order may swap: make it total."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # within a part the lower 33 bits of the id count its rows; both columns are fixed by writing them
    placed = staged(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sequence")
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each part
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") + start).drop("__part", "__at", "__before")

"""Connected components by repeated contraction, on tables in the shared folder; few links in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to so many links, 16 bytes each, are joined in one task instead of in rounds.
FEW_LINKS = 500_000


def trees(n: int, a, b):
    """For n nodes, the least node of each one's component under the links (a, b)."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of at most FEW_LINKS links (a, b)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = trees(len(nodes), places[: len(a)], places[len(a) :])
        for k in range(0, len(nodes), 50_000):
            yield pa.record_batch([pa.array(nodes[k : k + 50_000]), pa.array(nodes[root[k : k + 50_000]])], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(common.lean(run), "node long, root long")


def roots(tables: common.Scratch, links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b); root is the component's least node.

    In each round every node is merged into the neighbour that comes first in an order drawn anew for
    the round, so a constant share of the nodes goes on average, chains included. Only counts reach the
    driver; each round's tables are written, so a lost executor costs no more than its tasks. Links that are
    few by count are joined in one task: many small rounds would cost more than they spread.
    """
    edges = tables.written(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    if edges.count() <= FEW_LINKS:
        common.ship(tables.spark)
        return tables.written(_in_one_task(edges), "roots")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = tables.written(nodes.select("node", F.col("node").alias("label")), "labels")
    turn = 0
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("at"), F.col(c).alias("id"))  # noqa: E731, B023
        parent = both.groupBy("u").agg(F.min(order("v")).alias("best"))
        parent = parent.select("u", F.least("best", order("u"))["id"].alias("to"))
        parent = tables.written(parent, "parents")
        moved = (
            edges.join(parent.select(F.col("u").alias("a"), F.col("to").alias("a2")), "a")
            .join(parent.select(F.col("u").alias("b"), F.col("to").alias("b2")), "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        edges = tables.written(moved, "links")
        labels = labels.join(parent.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = tables.written(labels, "labels")
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("root"))
    return tables.written(labels.join(least, "label").select("node", "root"), "roots")

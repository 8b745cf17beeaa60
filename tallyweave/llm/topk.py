"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse integer rows (zeros are left out). Candidates are cut into blocks, each inverted
into weighted postings by term; a block of queries scatters its weights times those postings into a
dense score array, whose k best are kept by partition selection. Partial lists of all blocks are then
merged by query. Each task holds one block of either side, whatever the size of the table; no pair
leaves a task but the k best.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.
Vectors of unequal length are compared as if padded with zeros. A query is not compared with rows of
its own id. Rows that repeat an id are candidates one by one; as a query the least of them counts.
Scores are exact; beyond 64 bits they are clamped to the range of a long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component; only rows that take part."""
    v = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("terms"),
    )


class Postings:
    """A block of candidates by term: for each term the rows that have it and their weights."""

    def __init__(self, ids, rows):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.np, self.ids, self.n = np, np.asarray(ids)[order], len(ids)
        dense = _matrix([rows[i] for i in order.tolist()])
        self.largest = int(np.abs(dense).max(initial=0))
        self.terms = []
        for t in range(dense.shape[1]):
            own = np.flatnonzero(dense[:, t])
            if len(own):
                self.terms.append((t, own, dense[own, t].copy()))

    def best(self, query_ids, queries, k: int, step: int = 64):
        """(query id, candidate id, score) of the k best of each query in this block."""
        np = self.np
        out = []
        width = queries.shape[1]
        for a in range(0, len(query_ids), step):
            block, own = queries[a : a + step], np.asarray(query_ids[a : a + step])
            bound = int(np.abs(block).max(initial=0)) * self.largest * max(1, width)
            kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
            scores = np.zeros((len(own), self.n), kind)
            weights = block.astype(kind)
            spare = np.empty_like(scores)
            for t, rows, values in self.terms:
                if t >= width:
                    break
                w = weights[:, t]
                if not w.any():
                    continue
                values = values.astype(kind)
                if len(rows) == self.n:
                    np.multiply(w[:, None], values[None, :], out=spare)
                    np.add(scores, spare, out=scores)
                else:
                    scores[:, rows] += w[:, None] * values[None, :]
            if kind is object:
                scores = np.minimum(np.maximum(scores, -(1 << 63)), (1 << 63) - 1)
            twins = np.searchsorted(self.ids, own, "right") - np.searchsorted(self.ids, own, "left")
            for i, q in enumerate(own.tolist()):
                want = min(self.n, k + int(twins[i]))
                row = scores[i]
                limit = np.partition(row, self.n - want)[self.n - want]
                at = np.flatnonzero(row >= limit)
                # ids ascend, so a stable sort leaves ties to the smaller id
                at = at[np.argsort(-row[at].astype(object if kind is object else np.int64), kind="stable")]
                at = at[self.ids[at] != q][:k]
                out += [(q, c, int(s)) for c, s in zip(self.ids[at].tolist(), row[at].tolist(), strict=True)]
        return out


def _matrix(rows):
    import numpy as np

    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _rows(table, name: str):
    import numpy as np

    column = table.column(name).combine_chunks()
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


PAIR_SCHEMA = "query_id long, vec_id long, score long"


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int | None = None, block_queries: int = 4096) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score; ties go to the smaller id.

    vectors and queries have (vec_id, terms). Both sides meet by (candidate block, query block), each
    side copied to the blocks of the other; so the rows moved grow with the number of blocks, not of
    pairs. A block has 1,024 to 65,536 candidates, by the size of the table and the cores there are.
    """
    common.ship(spark)
    queries = queries.groupBy("vec_id").agg(F.min("terms").alias("terms"))
    n, n_queries = vectors.count(), queries.count()
    if block_rows is None:
        block_rows = min(65_536, max(1_024, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // block_queries))

    def spread(df: DataFrame, own: str, count: int, other: str, copies: int) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(count)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other),
            "vec_id",
            "terms",
        )

    key = ["block", "query_block"]
    left = spread(vectors, "block", blocks, "query_block", query_blocks).groupBy(*key)
    right = spread(queries, "query_block", query_blocks, "block", blocks).groupBy(*key)

    def search(candidates, asked):
        import pyarrow as pa

        found = []
        if candidates.num_rows and asked.num_rows:
            postings = Postings(candidates.column("vec_id").to_numpy(), _rows(candidates, "terms"))
            found = postings.best(asked.column("vec_id").to_pylist(), _matrix(_rows(asked, "terms")), k)
        names = ["query_id", "vec_id", "score"]
        return pa.table({name: pa.array([x[i] for x in found], pa.int64()) for i, name in enumerate(names)})

    partial = left.cogroup(right).applyInArrow(search, PAIR_SCHEMA)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = partial.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each vector whose id is divisible by 50."""
    vectors = quantised(common.table(spark, sf_dir, "embeddings"))
    return top_k(spark, vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.terms, b.terms), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

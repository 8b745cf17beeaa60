"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over consecutive words: it hashes the words under its ones and ignores the
others, so a substituted word breaks only the seeds that look at it. Every position of every benchmark
item and of every document is hashed under all masks; equal hashes align an item with a document at an
offset. An alignment is verified word by word: it counts if some WINDOW words of the item in a row (all
of a shorter one) have at least SIMILARITY of their words equal in the document.

Items of fewer than SHORT words have seeds of their own, one for each word that may differ (none below
five words), so that no pattern is missed; documents are hashed under them only for lengths that the
benchmark has. A caller who finds such items too weak a proof gives min_words.

Words are runs of letters and digits, lower-cased. Items without words or with a null id take no part.
Null texts are empty. Rows that share a document id are told apart by text in row_leaks and reported
together in leaks; null ids are one id. Empty tables give an empty result. Only ids and texts are read.

The seed table is broadcast if it has at most BROADCAST_SEEDS rows; otherwise both sides are shuffled on
the hash, places only, and the texts with hits are read again. Documents are hashed as they are read;
nothing of them is kept but the words around hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The last one is for ten words of which the sixth and seventh are replaced.
MASKS = ("111011", "1101011", "1011101", "11001011", "11100111")
SPAN = min(map(len, MASKS))
SHORT = max(map(len, MASKS))
WINDOW = 20
SIMILARITY = 0.8
BROADCAST_SEEDS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def short_masks(n: int) -> list[tuple[str, int]]:
    """(mask, its place in the item) for items of n < SHORT words: whole, or all but one word if 0.8 of them may do."""
    if n < 5:
        return [("1" * n, 0)]
    return [("1" * (n - 1), 0), ("1" * (n - 1), 1), *(("1" * g + "0" + "1" * (n - 1 - g), 0) for g in range(1, n - 1))]


def _seed(own: Column, at: Column, mask: str) -> Column:
    """The hash of a mask at a place; beyond the last word nothing is hashed, which equals no whole seed."""
    return F.xxhash64(F.lit(mask), *(F.get(own, at + i) for i, c in enumerate(mask) if c == "1"))


def _places(own: Column, span: int) -> Column:
    n = F.size(own) - span
    return F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(item_id, n, j, seed) of all items: under MASKS at every place, or under the masks of a short length."""
    own = F.col("item")
    long = items.filter(F.size("item") >= SHORT).select("item_id", "item", F.explode(_places(own, SPAN)).alias("j"))
    out = long.select("item_id", F.size("item").alias("n"), "j", F.explode(F.array(*(_seed(own, F.col("j"), m) for m in MASKS))).alias("seed"))
    for n in lengths:
        made = F.array(*(F.struct(F.lit(j).alias("j"), _seed(own, F.lit(j), m).alias("seed")) for m, j in short_masks(n)))
        out = out.unionByName(items.filter(F.size("item") == n).select("item_id", F.lit(n).alias("n"), F.explode(made).alias("x")).select("item_id", "n", "x.*"))
    return out


def text_key(text: str = "text") -> Column:
    """What tells rows of one id apart: the hash of the text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def row_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, min_words: int = 1, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """doc_id, row (text_key), item_id, offset, matched and similarity of every alignment that counts; rows are told apart by id and text."""
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item"))
        .filter(F.col("item_id").isNotNull() & (F.size("item") >= max(1, min_words)))
        .distinct()
    )
    items = common.written(spark, items, "items")
    # at most SHORT - 1 numbers
    lengths = sorted(r.n for r in items.filter(F.size("item") < SHORT).select(F.size("item").alias("n")).distinct().collect())
    seeds = common.written(spark, _item_seeds(items, lengths), "seeds")
    small = seeds.count() <= broadcast_seeds
    masks = sorted({*MASKS, *(m for n in lengths for m, _ in short_masks(n))})
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("row"), words(F.col("text")).alias("own"))
    at = placed.select("doc_id", "row", "own", F.explode(_places(F.col("own"), min(map(len, masks)))).alias("i"))
    hashed = at.select("doc_id", "row", "own", "i", F.explode(F.array(*(_seed(F.col("own"), F.col("i"), m) for m in masks))).alias("seed"))
    offset = (F.col("i") - F.col("j")).alias("offset")
    # what goes to the verification is the stretch of the document that the item would cover
    stretch = F.slice("own", F.greatest(F.col("offset"), F.lit(0)) + 1, F.col("n")).alias("stretch")
    if small:
        hits = hashed.join(F.broadcast(seeds), "seed").select("doc_id", "row", "own", "item_id", "n", offset)
        aligned = hits.select("doc_id", "row", "item_id", "offset", stretch).groupBy("doc_id", "row", "item_id", "offset").agg(F.first("stretch").alias("stretch"))
    else:
        hits = hashed.drop("own").join(seeds, "seed").select("doc_id", "row", "item_id", "n", offset).distinct()
        hits = common.written(spark, hits, "hits")
        again = placed.dropDuplicates(["doc_id", "row"]).alias("d").join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.row") == F.col("h.row")))
        aligned = again.select("h.doc_id", "h.row", "item_id", "offset", stretch)
    both = aligned.join(F.broadcast(items) if small else items, "item_id")
    shift = F.greatest(-F.col("offset"), F.lit(0))
    equal = F.transform("item", lambda w, p: F.when((p >= shift) & F.coalesce(F.get("stretch", p - shift) == w, F.lit(False)), 1).otherwise(0))
    width = F.least(F.size("item"), F.lit(window))
    compared = both.select("doc_id", "row", "item_id", "offset", equal.alias("equal"), width.alias("width"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1), lambda s: total(F.slice("equal", s, F.col("width")))))
    judged = compared.filter(total(F.col("equal")) >= F.col("width") * similarity).select(
        "doc_id", "row", "item_id", "offset", total(F.col("equal")).alias("matched"), (best / F.col("width")).alias("similarity")
    )
    return judged.filter(F.col("similarity") >= similarity)


def leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, min_words: int = 1, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """doc_id, item_id, similarity (best window), matched (equal words of the item), start (word of the document)."""
    kept = row_leaks(spark, docs, benchmark, window, similarity, min_words, broadcast_seeds)
    top = F.max(F.struct("similarity", "matched", (-F.col("offset")).alias("place")))
    return kept.groupBy("doc_id", "item_id").agg(top.alias("top")).select(
        "doc_id", "item_id", "top.similarity", "top.matched", F.greatest(-F.col("top.place"), F.lit(0)).alias("start")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return leaks(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

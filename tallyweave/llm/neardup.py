"""Near duplicates by BagMinHash, banding and verified multiset overlap.

Texts are multisets of five-word shingles; two are near duplicates if their weighted Jaccard similarity
is at least 0.8, and classes are the connected components of these links. Steps:

1. One pass gives each text a 128-bit fingerprint of its multiset, its size and 32 band hashes of four
   registers each; a pair at the threshold shares no band with a chance of 5e-8.
2. Texts with equal multisets are one node (their least id), whatever their number.
3. Nodes that share a band are candidates. In each round every band that still holds nodes of different
   components names pivots, from the smallest components; the band's nodes of other components are
   compared with them, and the pivots leave the band. So in the end every candidate pair is linked by a path or was
   compared, no pair is written twice, and a band of near copies costs its pivot's comparisons. There is
   no cap.
4. In bands of more than LARGE nodes, shingles that just one of the crowd has are counted first: no
   partner shares them, so nodes and pairs that cannot reach the threshold without them are ruled out.
5. A comparison counts the shingles of both whole texts.

Texts without words have no shingles and are in no class but their own. Null ids get a null class. Rows
that share an id count as one document that has the links of each of its texts; where such texts differ,
classes are found for the texts and joined by their ids. An empty table gives an empty result. Only id and
text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, components
from .tokenids import _slices

WIDTH = 5
SIMILARITY = 0.8
REGISTERS = 128
ROWS = 4
LARGE = 16
#: Most ids that are broadcast: 8 bytes each, some 32 MB as a hash table.
BROADCAST_IDS = 1_000_000


def sketch(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, bands) of docs (doc_id, text); the fingerprint is null and bands are empty without words."""
    common.ship(spark)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .bagminhash import bands, signatures
        from .shingles import mixed, multisets

        for ids, texts in _slices(batches, 700_000):
            hashes, counts, owner = multisets(texts, WIDTH)
            sums = []
            for salt in (1, 2):
                element = mixed(mixed(hashes + np.uint64(salt)) + counts.astype(np.uint64))
                total = np.zeros(len(texts) + 1, np.uint64)
                at = np.searchsorted(owner, np.arange(len(texts) + 1))
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(element)])
                total = running[at[1:]] - running[at[:-1]]
                sums.append(total.view(np.int64))
            size = np.bincount(owner, counts, len(texts)).astype(np.int64)
            empty = size == 0
            band = bands(signatures(hashes, counts, owner, len(texts), REGISTERS), ROWS).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(empty, 0, band.shape[1]))])
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sums[0], mask=empty),
                    pa.array(sums[1], mask=empty),
                    pa.array(size),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band[~empty].ravel())),
                ],
                names=["doc_id", "k1", "k2", "n", "bands"],
            )

    return docs.mapInArrow(common.lean(run), "doc_id long, k1 long, k2 long, n long, bands array<long>")


def _overlaps(spark: SparkSession, pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, shared, similar) of the pairs (a, b): how many shingles both texts have; texts has (node, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import multisets

        for batch in batches:
            left, right = batch.column("a"), batch.column("b")
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            keep, common = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
            start, size = 0, 0
            for i in range(len(a)):
                size += len(a[i]) + len(b[i])
                if size > 1_000_000 or i + 1 == len(a):
                    own = slice(start, i + 1)
                    hashes, counts, owner = multisets(a[own] + b[own], WIDTH)
                    n = i + 1 - start
                    cuts = np.searchsorted(owner, np.arange(2 * n + 1))
                    total = np.bincount(owner, counts, 2 * n)
                    for k in range(n):
                        x, y = slice(cuts[k], cuts[k + 1]), slice(cuts[n + k], cuts[n + k + 1])
                        _, p, q = np.intersect1d(hashes[x], hashes[y], assume_unique=True, return_indices=True)
                        shared = int(np.minimum(counts[x][p], counts[y][q]).sum())
                        joint = int(total[k] + total[n + k]) - shared
                        keep[start + k], common[start + k] = joint > 0 and shared >= similarity * joint, shared
                    start, size = i + 1, 0
            yield pa.record_batch([left, right, pa.array(common), pa.array(keep)], names=["a", "b", "shared", "similar"])

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    second = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return second.select("a", "b", "text_a", "text_b").mapInArrow(common.lean(run), "a long, b long, shared long, similar boolean")


def few(ids: DataFrame) -> DataFrame:
    """ids with a broadcast hint if they are few enough, else as they are, for a shuffled join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _shared_counts(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(node, c): how many of a text's shingles some other text of the table has too."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import multisets

        for batch in batches:
            hashes, counts, owner = multisets(batch.column(1).to_pylist(), WIDTH)
            # shingles of several texts of the batch are known to be shared: one row for all of them
            order = np.argsort(hashes, kind="stable")
            hashes, counts, owner = hashes[order], counts[order], owner[order]
            first = np.ones(len(hashes), bool)
            first[1:] = hashes[1:] != hashes[:-1]
            at = np.flatnonzero(first)
            met = np.diff(np.append(at, len(hashes)))
            nodes = batch.column(0).to_numpy()
            yield pa.record_batch([pa.array(hashes[at].view(np.int64)), pa.array(met), pa.array(nodes[owner[at]]), pa.array(counts[at])], names=["shingle", "met", "node", "times"])

    seen = texts.select("node", "text").mapInArrow(common.lean(run), "shingle long, met long, node long, times long")
    single = seen.groupBy("shingle").agg(F.sum("met").alias("met"), F.min(F.struct("node", "times")).alias("one")).filter("met = 1")
    return single.groupBy(F.col("one.node").alias("node")).agg(F.sum("one.times").alias("own"))


def _may_match(a: str, b: str, similarity: float):
    """Whether two texts of a band can be similar enough.

    They share at most c shingles each; and where both were compared with the band's first pivot, at most
    the lesser part that each has of it, and the lesser part of what else they share with anyone.
    """
    n, m, c, d, o, p = (F.col(f"{t}.{x}") for x in "nco" for t in (a, b))
    most = F.least(n, m, c, d)
    rest = F.greatest(F.least(c - o, d - p), F.lit(0))
    most = F.coalesce(F.least(most, F.least(o, p) + rest), most)
    return most >= (n + m - most) * similarity


def classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, large: int = LARGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size) for every row of docs; class_id is the least id of the class."""
    with common.Scratch(spark) as tables:
        return common.written(spark, _classes(spark, tables, docs, similarity, large, id_col, text_col), "classes")


def _with_sizes(found: DataFrame) -> DataFrame:
    """Classes with their sizes: only those of several rows are looked up, so that no class is gathered in one task."""
    sizes = few(found.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).filter("class_size > 1 AND class_id IS NOT NULL"))
    size = F.when(F.col("class_id").isNotNull(), F.coalesce("class_size", F.lit(1).cast("long"))).alias("class_size")
    return found.join(sizes, "class_id", "left").select("doc_id", "class_id", size)


def _classes(spark: SparkSession, tables: common.Scratch, docs: DataFrame, similarity: float, large: int, id_col: str, text_col: str) -> DataFrame:
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sketches = tables.written(sketch(spark, picked), "sketches")
    forms = sketches.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high"))
    if not forms.filter("NOT (low <=> high)").isEmpty():
        return _classes_of_ids(spark, tables, picked, similarity, large)
    nodes = sketches.filter("doc_id IS NOT NULL AND k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    nodes = tables.written(nodes, "nodes")
    keyed = sketches.join(nodes.select(F.col("node").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    spread = keyed.select(F.col("doc_id").alias("node"), "n", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).filter("members > 1")
    rows = tables.written(spread.join(shared, "band"), "bands")
    roots = tables.written(rows.select("node", F.col("node").alias("root")).distinct(), "roots")
    texts = picked.join(few(roots.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    texts = tables.written(texts.select(F.col("doc_id").alias("node"), "text"), "texts")

    rows = rows.withColumn("c", F.col("n")).withColumn("o", F.lit(None).cast("long"))
    crowd = tables.written(rows.filter(F.col("members") > large).select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        own = tables.written(_shared_counts(spark, texts.join(few(crowd), "node", "left_semi")), "own")
        rows = rows.join(few(own), "node", "left").withColumn("c", F.when(F.col("members") > large, F.col("n") - F.coalesce("own", F.lit(0))).otherwise(F.col("n"))).drop("own")
        # the best partner that the band could have shares c shingles and has no others but the least size asks for
        rows = rows.filter(F.col("c") >= (F.col("n") + F.greatest("least", "c") - F.col("c")) * similarity)
        rows = tables.written(rows, "bands")
    tested = None
    turn = 0
    while True:
        placed = rows.join(roots, "node")
        split = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
        placed = tables.written(placed.join(split, "band"), "open")
        if placed.isEmpty():
            break
        # pivots: texts of components with few members first, and those with the largest shared parts
        sizes = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
        place = F.row_number().over(Window.partitionBy("band").orderBy("size", (-F.col("c") / F.col("n")), F.xxhash64("node"), "node"))
        limit = 1 if turn == 0 else 8 * 4 ** min(turn - 1, 5)
        pivots = placed.join(sizes, ["band", "root"]).withColumn("place", place).filter(F.col("place") <= limit)
        pivots = tables.written(pivots.select("band", "root", "node", "n", "c", "o", *(["own"] if turn else [])), "pivots")
        # all that could be near the first pivot by size are compared with it: what they share bounds what they share with each other
        by_size = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity
        # later, a pair is written in the least of its common bands only; it stays there until one of the two is a pivot
        least_band = F.array_min(F.array_intersect("x.own", "y.own")) == F.col("band")
        wanted = by_size if turn == 0 else _may_match("x", "y", similarity) & least_band
        met = placed.alias("x").join(pivots.alias("y"), "band").filter((F.col("x.root") != F.col("y.root")) & wanted)
        pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = tables.written(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        judged = tables.written(_overlaps(spark, pairs, texts, similarity), "judged")
        found = judged.filter("similar")
        if not found.isEmpty():
            links = found.join(roots.select(F.col("node").alias("a"), F.col("root").alias("p")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("q")), "b")
            merged = components.roots(tables, links.select(F.col("p").alias("a"), F.col("q").alias("b")))
            moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            roots = tables.written(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        if turn == 0:
            first = pivots.select("band", F.col("node").alias("pivot"))
            seen = placed.drop("o").join(first, "band").withColumn("a", F.least("node", "pivot")).withColumn("b", F.greatest("node", "pivot"))
            placed = seen.join(judged.select("a", "b", F.col("shared").alias("o")), ["a", "b"], "left").drop("a", "b", "pivot")
            placed = placed.join(rows.groupBy("node").agg(F.collect_set("band").alias("own")), "node")
        # a pivot has met all of its band
        rows = placed.drop("root").join(pivots.select("band", "node"), ["band", "node"], "left_anti")
        turn += 1
    of_node = nodes.join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("class_id"))
    found = sketches.select("doc_id", "k1", "k2").join(of_node, ["k1", "k2"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return _with_sizes(tables.written(found, "found"))


def _hashed(*columns):
    return F.xxhash64(*columns)


def with_row_keys(spark: SparkSession, tables: common.Scratch, rows: DataFrame) -> DataFrame:
    """rows (id, text, ...) with key: a 64-bit number for each different (id, text), exact as far as 128 bits tell rows apart.

    64 bits alone would meet by chance among some 1e10 rows. So both halves of a 128-bit hash are written, and
    first halves that stand for several rows give way to numbers of their own; the search is repeated until none is left.
    """
    one, two = _hashed("id", "text"), F.xxhash64("text", "id", F.lit(1))
    halves = tables.written(rows.select(one.alias("key"), two.alias("two")).distinct(), "halves")
    keyed, turn = rows.withColumns({"key": one, "two": two}), 0
    while True:
        shared = tables.written(halves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
        if shared.isEmpty():
            return keyed.drop("two")
        turn += 1
        # the result reads these few keys, so they outlive the scratch tables
        marked = few(common.written(spark, shared, "shared")).withColumn("shared", F.lit(True))
        apart = F.when(F.col("shared"), F.xxhash64("key", "two", F.lit(turn))).otherwise(F.col("key"))
        halves = tables.written(halves.join(marked, "key", "left").select(apart.alias("key"), "two"), "halves")
        keyed = keyed.join(marked, "key", "left").withColumn("key", apart).drop("shared")


def _classes_of_ids(spark: SparkSession, tables: common.Scratch, picked: DataFrame, similarity: float, large: int) -> DataFrame:
    """What classes() gives where texts that share an id differ: nodes are texts, and all texts of an id are in one class."""
    known = picked.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    keyed = with_row_keys(spark, tables, known).select(F.col("id").alias("doc_id"), F.col("key").alias("row"), "text")
    found = classes(spark, keyed.select("row", "text").distinct(), similarity, large, "row").select(F.col("doc_id").alias("row"), "class_id")
    placed = tables.written(keyed.select("doc_id", "row").distinct().join(found, "row").select("doc_id", "class_id").distinct(), "placed")
    links = placed.join(placed.groupBy("doc_id").agg(F.min("class_id").alias("a")), "doc_id").select("a", F.col("class_id").alias("b"))
    joined = components.roots(tables, links).select(F.col("node").alias("class_id"), "root")
    placed = placed.join(joined, "class_id", "left").select("doc_id", F.coalesce("root", "class_id").alias("root")).distinct()
    placed = tables.written(placed, "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "class_id")
    return _with_sizes(tables.written(picked.select("doc_id").join(named, "doc_id", "left"), "found"))


def one_of_each(spark: SparkSession, docs: DataFrame, null_ids: bool = False) -> DataFrame:
    """docs with one row of each class: the one with the least id and, of several texts of that id, the least key.

    Rows are told apart by id and text, and of rows equal in both one stays. Rows with null ids all stay,
    or take part behind all others if null_ids is set; those without words stay. All columns are kept.
    """
    with common.Scratch(spark) as tables:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), text.alias("text"))
        keyed = with_row_keys(spark, tables, rows)
        worded = F.col("text").rlike(r"[0-9A-Za-z_]|[^\x00-\x7f]")
        part = keyed.filter(F.col("id").isNotNull() | (worded if null_ids else F.lit(False))).select("id", "key", "text")
        found = tables.written(classes(spark, part, id_col="key").withColumnRenamed("doc_id", "key"), "found")
        several = tables.written(found.filter("class_size > 1").select("key", "class_id").distinct(), "several")
        members = tables.written(part.select("key", "id").distinct().join(few(several), "key"), "members")
        first = members.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first"))
        first = tables.written(first.select("class_id", F.col("first.key").alias("first")), "first")
        # what the result reads stays: keys of rows that go, and of rows that repeat
        gone = common.written(spark, members.join(few(first), "class_id").filter("key <> first").select("key").distinct(), "gone")
        kept = keyed.join(few(gone), "key", "left_anti").select("key", "doc")
        repeated = common.written(spark, found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return kept.select("doc.*")
    again = few(repeated)
    once = kept.join(again, "key", "left_semi").dropDuplicates(["key"])
    return kept.join(again, "key", "left_anti").unionByName(once).select("doc.*")


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(spark, common.table(spark, sf_dir, "documents"))

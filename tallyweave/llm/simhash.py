"""Near duplicates by SimHash, found by meet-in-the-middle ball hashing.

A text's words are runs of anything but ASCII white space, A-Z in lower case. Its features are the XXH64
hashes (UTF-8, seed 42) of all runs of four words, repeats included; a shorter text has one feature, all
its words. A bit of the fingerprint is 1 if more than half of the features have it. Fingerprints that
differ in at most RADIUS bits are linked; classes are the connected components.

1. Each distinct fingerprint is one node, whatever the number of its texts.
2. Two fingerprints within RADIUS have a variant in common that lies within HALF of either. So each
   fingerprint writes out all its variants, and those that are equal meet. A variant's bucket is a linear
   hash of its bits: the same flips move any fingerprint's bucket by the same amount. Hence a fingerprint
   is sent once to a bucket, not once a variant, and its variants of that bucket are written out there.
3. In a bucket equal variants are found by sorting, a slice of the bucket at a time. All that meet at a
   variant are linked with the first of them, links are verified by counting bits and joined to trees, so
   that crowds cost no pairs. Any two within RADIUS meet at some variant: no link is lost.
4. Components over all buckets are found on tables in the shared folder.

Null text is empty; a text without words has fingerprint zero and is linked like any other. Each row is
judged alone, also where rows share an id or repeat. Rows with a null id link others; their class is the least id
in it, null if there is none. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components
from .neardup import few

WIDTH = 4
SEED = 42
RADIUS = 4
HALF = RADIUS // 2
#: Buckets are 2 ** BITS; there are more once a bucket would hold over HELD fingerprints of 8 bytes.
BITS = 7
HELD = 16_000_000
#: About so many variants are sorted at once.
SORTED = 4_000_000


def fingerprint(text: bytes):
    """The 64-bit fingerprint of one whole UTF-8 text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.uint64(0)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= WIDTH:
        starts, ends = starts[: len(words) - WIDTH + 1], ends[WIDTH - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    found = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    octets = np.array(found, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _octet_bits() for k in range(8)])
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0]


@cache
def _octet_bits():
    """The bits of each octet, lowest first."""
    import numpy as np

    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, print) of docs (doc_id, text); the fingerprint's 64 bits as a signed number."""
    common.ship(spark)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.mapInArrow(common.lean(run), "doc_id long, print long")


@cache
def flips():
    """All masks of at most HALF bits."""
    from itertools import combinations

    import numpy as np

    return np.array([sum(1 << b for b in bits) for n in range(HALF + 1) for bits in combinations(range(64), n)], np.uint64)


@cache
def _octet_places():
    import numpy as np

    from .shingles import mixed

    columns = mixed(np.arange(1, 65, dtype=np.uint64)).reshape(8, 8)
    set_bits = _octet_bits().astype(bool)
    return np.stack([np.bitwise_xor.reduce(np.where(set_bits, columns[k], np.uint64(0)), axis=1) for k in range(8)])


def place(values):
    """A linear hash of 64-bit values: place(x ^ y) is place(x) ^ place(y)."""
    import numpy as np

    octets = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return np.bitwise_xor.reduce([_octet_places()[k][octets[:, k]] for k in range(8)], axis=0)


def sent(prints, bits: int):
    """(bucket, fingerprints that have variants in it) for all buckets that some of the fingerprints reach."""
    import numpy as np

    mask = np.uint64((1 << bits) - 1)
    moves = np.unique(place(flips()) & mask)
    buckets = ((place(prints) & mask)[:, None] ^ moves).ravel()
    order = np.argsort(buckets, kind="stable")
    owners, buckets = np.repeat(prints, len(moves))[order], buckets[order]
    cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    for start, end in zip(cuts, [*cuts[1:], len(buckets)], strict=True):
        yield int(buckets[start]), owners[start:end]


def meetings(prints, bucket: int, bits: int, most: int = SORTED):
    """(a, b): places in prints whose fingerprints share a variant of the bucket, b's with the first that has it."""
    import numpy as np

    masks = flips()
    finer = max(0, int(np.ceil(np.log2(max(1, len(prints) * len(masks) / (1 << bits) / most)))))
    mask = np.uint64((1 << bits + finer) - 1)
    moved = place(masks) & mask
    by_move = np.argsort(moved, kind="stable")
    moved, masks = moved[by_move], masks[by_move]
    at = place(prints) & mask
    order = np.argsort(at, kind="stable")
    at = at[order]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.append(cuts[1:], len(at))
    for part in range(1 << finer):
        move = at[cuts] ^ np.uint64(bucket | part << bits)
        low, high = np.searchsorted(moved, move), np.searchsorted(moved, move, "right")
        used = np.flatnonzero(high > low)
        if not len(used):
            continue
        made = [(prints[order[cuts[g] : ends[g]], None] ^ masks[low[g] : high[g]]).ravel() for g in used]
        starts = np.cumsum([0, *map(len, made)])
        variants = np.concatenate(made)
        del made
        ranked = np.sort(variants)
        equal = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(equal):
            continue
        # few variants have an equal: most others fall out by their low bits
        low_bits = np.zeros(1 << 20, bool)
        low_bits[equal & np.uint64(0xFFFFF)] = True
        hits = np.flatnonzero(low_bits[variants & np.uint64(0xFFFFF)])
        where = np.searchsorted(equal, variants[hits])
        same = equal[np.minimum(where, len(equal) - 1)] == variants[hits]
        hits, where = hits[same], where[same]
        group = np.searchsorted(starts, hits, "right") - 1
        owner = order[cuts[used[group]] + (hits - starts[group]) // (high - low)[used[group]]]
        ranks = np.lexsort((owner, where))
        owner, where = owner[ranks], where[ranks]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        heads = np.repeat(owner[first], np.diff(np.append(first, len(where))))
        other = heads != owner
        yield heads[other], owner[other]


def links(spark: SparkSession, nodes: DataFrame, n: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs within RADIUS; nodes has n distinct values of print."""
    common.ship(spark)
    bits = BITS
    reach = len(flips())
    while n * min(reach, 1 << bits) / (1 << bits) > HELD:
        bits += 1

    def send(batches):
        import numpy as np
        import pyarrow as pa

        def rows(held):
            found = list(sent(np.concatenate(held), bits))
            for k in range(0, len(found), 1024):
                part = found[k : k + 1024]
                yield pa.record_batch([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1].tobytes() for x in part], pa.binary())], names=["bucket", "prints"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= 8192:
                yield from rows(held)
                held, size = [], 0
        if size:
            yield from rows(held)

    def meet(table):
        import numpy as np
        import pyarrow as pa

        bucket = table.column("bucket")[0].as_py()
        prints = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("prints")]))
        root = np.arange(len(prints))
        for a, b in meetings(prints, bucket, bits):
            near = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
            merged = components.trees(len(prints), root[a[near]], root[b[near]])
            root = merged[root]
        tied = np.flatnonzero(root != np.arange(len(prints)))
        return pa.table({"a": prints[root[tied]].view(np.int64), "b": prints[tied].view(np.int64)})

    dealt = nodes.select("print").mapInArrow(common.lean(send), "bucket long, prints binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    with common.Scratch(spark) as tables:
        picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        prints = tables.written(fingerprints(spark, picked), "prints")
        nodes = tables.written(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
        roots = components.roots(tables, tables.written(links(spark, nodes, nodes.count()), "links"))
        placed = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").filter("n > 1 OR root IS NOT NULL")
        placed = placed.select("print", "first", F.coalesce("root", "print").alias("root"))
        least = placed.groupBy("root").agg(F.min("first").alias("least"))
        several = tables.written(placed.join(least, "root").select("print", "least"), "several")
        found = prints.join(few(several.withColumn("met", F.lit(True))), "print", "left")
        hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
        return common.written(spark, found.select("doc_id", hexed, F.when(F.col("met"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")), "simhash")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return classes(spark, common.table(spark, sf_dir, "documents"))

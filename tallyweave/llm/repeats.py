"""Repeated strings, found with a blockwise, difference-cover suffix sort.

Every byte covered by a string of LENGTH bytes that also starts elsewhere, in any text, goes. Besides,
stretches are told whose every word lies in PASSAGE words in a row that another row has too (case and
punctuation aside), however few bytes these are. Both are found in the same way, over symbols: bytes, or
the 64-bit hashes of the words. Windows are the strings of that length; a window's mark is the least
hash of the shorter strings in it, so equal windows have equal marks, and neighbouring windows form runs
with one mark. Steps:

1. Equal texts are one class (128-bit key); a class of several rows goes whole, and one row stands for
   it in what follows.
2. Runs with coarse marks; a mark met once rules its windows out. Nothing else is dropped.
3. What is left is cut into runs with fine marks. Runs met more than once, symbol for symbol, are
   repeats; one of each stands for them. A mark with one form met once is ruled out.
4. The forms of a mark are a bucket: a few texts, equal in their long middle parts. Buckets are dealt
   out and their windows' suffixes sorted in blocks of bounded size (see suffixes.py). A bucket of more
   than HOT forms is split first by the place of the mark in the window and by the symbols that all
   windows with the mark at that place have; equal windows stay together, and equal pieces become one.
5. Repeated windows of a class are put together.

So the suffixes sorted are those that have a near twin, and a passage met a million times is sorted
once. Positions are bytes of the UTF-8 text; null texts are empty. Rows may repeat, which makes them
copies. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .neardup import few

LENGTH = 400
COARSE = 32
FINE = 360
#: Words of a passage, and of its coarse and fine marks.
PASSAGE = 51
WORD_MARKS = (12, 44)
BLOCK_BYTES = 1_500_000
HOT = 256
SLOTS = 8
KEY = ["k1", "k2"]


def _sums(raw):
    import numpy as np

    from .shingles import powers

    up, _ = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def _hashes(sums, width: int):
    """The hash of each string of `width` symbols."""
    from .shingles import mixed, powers

    n = len(sums) - width
    return mixed((sums[width:] - sums[:-width]) * powers(len(sums))[1][:n])


def marked_runs(raw, width: int, length: int):
    """(mark, first window, number of windows) of the runs of an array of at least `length` symbols, and its prefix sums.

    A run ends where the place of the mark does, so that no two windows of a run are equal.
    """
    import numpy as np

    sums = _sums(raw)
    hashes = _hashes(sums, width)
    span = length - width + 1
    n = len(raw) - length + 1
    # least hash of each window of `span` hashes, from the running minima of blocks of that size
    padded = np.concatenate([hashes, np.full(-len(hashes) % span, np.uint64(2**64 - 1))]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (hashes[: n - 1] == least[:-1])
    starts = np.flatnonzero(new)
    return least[starts], starts, np.diff(np.append(starts, n)), sums


def _symbols(text: str, unit: int):
    """A text as an array: its bytes (unit 1), or the hashes of its words (unit 8)."""
    import numpy as np

    if unit == 1:
        return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    from .shingles import word_hashes

    return word_hashes([text])[0]


def _array(columns, names, kinds):
    import pyarrow as pa

    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _coarse(unit: int, length: int, coarse: int, across: bool):
    """Runs by coarse marks; across rows, a text of which there are copies counts twice."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["k1", "k2", "mark", "start", "n", "met"]
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            out, rows = [[], [], [], []], []
            for i, (text, copied) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                raw = _symbols(text.as_py(), unit)
                if len(raw) >= length:
                    mark, start, n, _ = marked_runs(raw, coarse, length)
                    # neighbours with one mark, as in text that repeats a line, make one row
                    first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
                    met = np.diff(np.append(first, len(mark)))
                    mark, start, n = mark[first], start[first], np.add.reduceat(n, first)
                    met = met * 2 if across and copied else met
                    rows.append((i, len(mark)))
                    for o, x in zip(out, (mark.view(np.int64), start, n, met), strict=True):
                        o.append(x)
            if rows:
                at = np.repeat([r[0] for r in rows], [r[1] for r in rows])
                yield _array([k1[at], k2[at], *map(np.concatenate, out)], names, [pa.int64()] * 3 + [pa.int32()] * 3)

    return run


def _fine(unit: int, length: int, fine: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import mixed, powers

        names = ["k1", "k2", "copied", "mark", "form", "start", "n"]
        for batch in batches:
            k1, k2, copied = (batch.column(i).to_numpy() for i in (0, 1, 2))
            out, rows = [[], [], [], []], []
            for i, (text, own) in enumerate(zip(batch.column(3), batch.column(4).to_pylist(), strict=True)):
                raw = _symbols(text.as_py(), unit)
                for first, last in _joined([(x["start"], x["start"] + x["n"]) for x in own]):
                    mark, start, n, sums = marked_runs(raw[first : last + length - 1], fine, length)
                    end = start + n + length - 1
                    form = mixed((sums[end] - sums[start]) * powers(len(raw))[1][start] + n.astype(np.uint64))
                    rows.append((i, len(mark)))
                    for o, x in zip(out, (mark.view(np.int64), form.view(np.int64), start + first, n), strict=True):
                        o.append(x)
            if rows:
                at = np.repeat([r[0] for r in rows], [r[1] for r in rows])
                yield _array([k1[at], k2[at], copied[at], *map(np.concatenate, out)], names, [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 2)

    return run


def _joined(spans):
    """Overlapping and touching (start, end) spans put together."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


PIECE = "mark long, slot int, core long, form long, sub long, k1 long, k2 long, at int, n int, wide boolean, piece binary"


def _cut(unit: int, length: int, fine: int, slots: int):
    """The pieces asked for; those of hot marks in parts by the place of the mark (see the module's step 4)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import mixed, powers

        names = [x.split()[0] for x in PIECE.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        places = length - fine + 1
        chunk = -(-places // slots)
        for batch in batches:
            rows = []
            for k1, k2, text, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = _symbols(text, unit)
                for x in own:
                    piece = raw[x["start"] : x["start"] + x["n"] + length - 1]
                    if not x["hot"]:
                        rows.append((x["mark"], -1, 0, x["form"], x["form"], k1, k2, 0, x["n"], x["wide"], piece.tobytes()))
                        continue
                    sums = _sums(piece)
                    hashed = lambda a, b: int(mixed((sums[b : b + 1] - sums[a : a + 1]) * powers(len(piece))[1][a : a + 1]).view(np.int64)[0])  # noqa: E731, B023
                    mark = int(np.argmax(_hashes(sums, fine).view(np.int64) == x["mark"]))
                    # windows k with the mark at places slot * chunk to (slot + 1) * chunk - 1
                    for slot in range(slots):
                        first, last = max(mark - (slot + 1) * chunk + 1, 0), min(mark - slot * chunk, x["n"] - 1)
                        if first <= last:
                            a, b = mark - slot * chunk, mark - (slot + 1) * chunk + 1 + length
                            core = hashed(a, min(b, len(piece)))
                            sub = hashed(first, last + length) ^ (mark - first)
                            rows.append((x["mark"], slot, core, x["form"], sub, k1, k2, first, last - first + 1, x["wide"], piece[first : last + length].tobytes()))
            if rows:
                yield _array(list(zip(*rows, strict=True)), names, kinds)

    return run


def _sorted_blocks(unit: int, length: int, block_bytes: int, across: bool):
    """Repeated windows of the pieces of each bucket; a partition's rows come sorted by bucket."""

    def settle(rows, cover):
        import numpy as np
        import pyarrow as pa

        from .suffixes import repeated

        sizes = np.array([len(r[8]) for r in rows])
        begins = np.cumsum(sizes) - sizes
        counts = np.array([r[6] for r in rows])
        at = np.repeat(begins, counts) + unit * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        owner = None
        if across:
            number: dict = {}
            owner = np.repeat(np.array([-1 if r[7] else number.setdefault((r[4], r[5]), len(number)) for r in rows], np.int64), counts)
        hit = repeated(np.frombuffer(b"".join(r[8] for r in rows), np.uint8), at, cover, owner)
        found, k = [], 0
        for r, n in zip(rows, counts.tolist(), strict=True):
            own, k = hit[k : k + n], k + n
            if not r[7] and own.any():
                change = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                found += [(*r[:4], a, b - a) for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)]
        if found:
            yield _array(list(zip(*found, strict=True)), ["mark", "slot", "core", "sub", "off", "m"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    def run(batches):
        from .suffixes import Cover

        cover, rows, size = Cover(length * unit), [], 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if size >= block_bytes and r[:3] != rows[-1][:3]:
                    yield from settle(rows, cover)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[8])
        if rows:
            yield from settle(rows, cover)

    return run


def _remove(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k1, k2, text, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans = _joined([(x["start"], x["start"] + x["n"] - 1 + length) for x in own])
                kept, last = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[last:a])
                    last = b
                kept.update(raw[last:])
                rows.append((k1, k2, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), spans))
            if rows:
                yield _array(list(zip(*rows, strict=True)), ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "spans"], [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64()))])

    return run


def _stretches(length: int):
    """Passages of a text, windows put together: how many, and their words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k1, k2, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                spans = _joined([(x["start"], x["start"] + x["n"] - 1 + length) for x in own])
                rows.append((k1, k2, len(spans), sum(b - a for a, b in spans)))
            if rows:
                yield _array(list(zip(*rows, strict=True)), ["k1", "k2", "n_passages", "passage_words"], [pa.int64()] * 4)

    return run


def repeated_windows(spark: SparkSession, tables: common.Scratch, texts: DataFrame, unit: int, length: int, coarse: int, fine: int, block_bytes: int, hot: int, across: bool) -> tuple[DataFrame, DataFrame]:
    """Of distinct texts (k1, k2, copied, text): those with windows left after coarse marks, and (k1, k2, start, n) of their repeated windows.

    With across, a window has to be in another row too: in a text of which there are copies (copied is 1), or in two texts.
    """
    wide = tables.written(texts.select(*KEY, "text", "copied").mapInArrow(common.lean(_coarse(unit, length, coarse, across)), "k1 long, k2 long, mark long, start int, n int, met int"), "coarse")
    again = wide.groupBy("mark").agg(F.sum("met").alias("met")).filter("met > 1").select("mark")
    segments = wide.drop("met").join(again, "mark").groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("own"))
    segments = tables.written(segments, "segments")
    near = texts.join(few(segments.select(*KEY)), KEY, "left_semi").join(segments, KEY)
    near = tables.written(near.select(*KEY, "copied", "text", "own"), "near")

    runs = tables.written(near.mapInArrow(common.lean(_fine(unit, length, fine)), "k1 long, k2 long, copied int, mark long, form long, start int, n int"), "fine")
    one = F.struct(*KEY, "start", "n")
    forms = runs.groupBy("mark", "form").agg(F.count(F.lit(1)).alias("met"), F.min(one).alias("one"), F.max(F.struct(*KEY)).alias("last"), F.max("copied").alias("copied"))
    several = (F.struct("one.k1", "one.k2") != F.col("last")) | (F.col("copied") == 1) if across else F.col("met") > 1
    forms = tables.written(forms.select("mark", "form", "one", several.alias("wide")), "forms")
    whole = forms.filter("wide").select("mark", "form", F.lit(0).alias("at"), F.col("one.n").alias("m"))
    buckets = forms.groupBy("mark").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("mark", (F.col("forms") > hot).alias("hot"))
    asked = forms.join(buckets, "mark").select("one.k1", "one.k2", "hot", F.struct("mark", "form", "one.start", "one.n", "wide", "hot").alias("x"))
    asked = tables.written(asked.groupBy(*KEY, "hot").agg(F.collect_list("x").alias("own")), "asked")
    texts = near.select(*KEY, "text")
    cut = lambda own: texts.join(own.drop("hot"), KEY).select(*KEY, "text", "own").mapInArrow(common.lean(_cut(unit, length, fine, SLOTS)), PIECE)
    place = ["mark", "slot", "core", "sub"]
    row = [*place, *KEY, "n", "wide", "piece"]
    # equal pieces of a hot mark become one; they are repeats of each other
    parts = tables.written(cut(asked.filter("hot")), "parts")
    split = parts.groupBy(*place).agg(
        F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high"), F.max("n").alias("n"), F.max("wide").alias("wide"), F.count(F.lit(1)).alias("met"), F.max("piece").alias("piece")
    )
    many = F.col("wide") | (F.col("low") != F.col("high") if across else F.col("met") > 1)
    split = tables.written(split.select(*place, "low.*", "n", many.alias("wide"), "piece"), "split")
    dealt = cut(asked.filter("NOT hot")).select(*row).unionByName(split).repartition("mark", "slot", "core").sortWithinPartitions("mark", "slot", "core")
    found = dealt.mapInArrow(common.lean(_sorted_blocks(unit, length, block_bytes, across)), "mark long, slot int, core long, sub long, off int, m int")
    found = found.unionByName(split.filter("wide").select(*place, F.lit(0).alias("off"), F.col("n").alias("m")))
    found = tables.written(found, "found")
    plain = found.filter("slot < 0").select("mark", F.col("sub").alias("form"), F.col("off").alias("at"), "m")
    parted = found.filter("slot >= 0").join(parts.filter("NOT wide").select(*place, "form", "at"), place).select("mark", "form", (F.col("at") + F.col("off")).alias("at"), "m")
    hits = whole.unionByName(plain).unionByName(parted)
    return near, runs.join(hits, ["mark", "form"]).select(*KEY, (F.col("start") + F.col("at")).alias("start"), F.col("m").alias("n"))


def repeats(
    spark: SparkSession,
    docs: DataFrame,
    length: int = LENGTH,
    coarse: int = COARSE,
    fine: int = FINE,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    passage: int = PASSAGE,
    word_marks: tuple[int, int] = WORD_MARKS,
    hot: int = HOT,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed byte spans, n_passages and passage_words of every row of docs."""
    common.ship(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text"), "n_bytes": F.octet_length("text").cast("long")}
    )
    copies = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    copies = common.written(spark, copies, "copies")
    several = copies.filter("copies > 1").select(*KEY, "least", F.lit(True).alias("several"))
    # a passage has fewer bytes than words only where there are none
    long_rows = rows.filter(F.col("n_bytes") >= min(length, 2 * passage - 1))
    lone = long_rows.join(few(several), KEY, "left").filter("several IS NULL OR doc_id <=> least")
    lone = lone.select(*KEY, F.coalesce("several", F.lit(False)).cast("int").alias("copied"), "text")

    with common.Scratch(spark) as tables:
        near, windows = repeated_windows(spark, tables, lone.filter(F.octet_length("text") >= length), 1, length, coarse, fine, block_bytes, hot, False)
        cut = near.drop("own", "copied").join(windows.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("own")), KEY).select(*KEY, "text", "own")
        cut = cut.mapInArrow(common.lean(_remove(length)), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
        cut = common.written(spark, cut.dropDuplicates(KEY), "removed")
    with common.Scratch(spark) as tables:
        _, windows = repeated_windows(spark, tables, lone, 8, passage, *word_marks, block_bytes, hot, True)
        told = windows.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("own")).mapInArrow(common.lean(_stretches(passage)), "k1 long, k2 long, n_passages long, passage_words long")
        told = common.written(spark, told, "passages")

    known = copies.select(*KEY, "copies").join(cut, KEY, "left").join(told, KEY, "left")
    every = rows.select("doc_id", *KEY, "n_bytes", F.sha2("text", 256).alias("whole")).join(known, KEY)
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.lit(0).cast("long")
    pick = lambda all_of_it, name, none: F.when(gone, all_of_it).otherwise(F.coalesce(name, none))
    return every.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), "n_removed", none).alias("n_removed"),
        pick(F.lit(1).cast("long"), "n_spans", none).alias("n_spans"),
        pick(F.lit(hashlib.sha256().hexdigest()), "kept_sha256", F.col("whole")).alias("kept_sha256"),
        pick(F.array(F.array(none, F.col("n_bytes"))), "spans", F.array().cast("array<array<bigint>>")).alias("spans"),
        F.coalesce("n_passages", none).alias("n_passages"),
        F.coalesce("passage_words", none).alias("passage_words"),
    )


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeated strings of 400 bytes are removed, and its passages of over 50 words that other documents have too."""
    return repeats(spark, common.table(spark, sf_dir, "documents")).drop("spans")

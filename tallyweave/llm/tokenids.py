"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Layout below one folder: ``part-00000.bin`` holds the ids of consecutive documents, nothing between
them; ``part-00000.idx`` holds n+1 int64 offsets local to that part, then n int64 document ids, then n
bytes that are 1 where the id is null; ``manifest.json`` lists the parts in document order, each with
its base: the ids of all parts before it, a prefix sum of the parts' counts. Ids are 16 bits wide
where the vocabulary allows, else 32. Both kinds of file are read by memory mapping.

Order is (id, hash of the text, text), null ids first. Null texts count as empty and hold only the end
id. Rows may repeat: each gets its own entry. An empty table gives a manifest with no documents.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_CHUNK = re.compile(rf"\s?[{_LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|$)|\s?\S+|\s+(?=\s\S)|\s+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_JOINABLE = re.compile(r"\s\S+")


class ChunkEncoder:
    """Byte-level BPE of whole texts through the tokenizers library, with a cache by chunk.

    The vocabulary's pre-tokenizer never joins two chunks of ``_CHUNK``: a run of white space gives its
    last character to the word behind it and is a token of its own otherwise, and a run of letters ends
    where another character follows. So chunks are encoded once per worker and their ids put together;
    a full cache loses its older half. Texts with U+001C..U+001F, which only one side counts as white
    space, are encoded whole; so are texts with an added token, which splits them before the
    pre-tokenizer and leaves a run of white space in front of it together.
    """

    LIMIT = 1_000_000

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.np = np
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = sorted(set(special.values()))
        self.n_bytes = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(special[i].encode()) if i in special else len(token)
        self.cache: dict[str, bytes] = {}

    def _ids(self, *texts: str):
        """Ids of the texts, one after the other; offsets, which nobody needs, are not made."""
        return self.np.concatenate([self.np.asarray(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)])

    def _learn(self, missing: list[str]) -> None:
        np = self.np
        together = [c for c in missing if _JOINABLE.fullmatch(c)]
        if together:
            ids = self._ids(*("".join(together[i : i + 500]) for i in range(0, len(together), 500)))
            ends = np.cumsum(self.n_bytes[ids])
            wanted = np.cumsum([len(c.encode()) for c in together])
            cuts = np.searchsorted(ends, wanted)
            if len(ids) and cuts[-1] < len(ids) and np.array_equal(ends[cuts], wanted):
                raw, size, start = ids.tobytes(), self.dtype.itemsize, 0
                for c, cut in zip(together, ((cuts + 1) * size).tolist(), strict=True):
                    self.cache[c] = raw[start:cut]
                    start = cut
        for c in missing:
            if c not in self.cache:
                self.cache[c] = self._ids(c).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned integers."""
        whole = [bool(_ODD_SPACE.search(t)) or any(c in t for c in self.added) for t in texts]
        chunks = [[] if odd else _CHUNK.findall(t) for t, odd in zip(texts, whole, strict=True)]
        seen = set().union(*chunks) if chunks else set()
        if len(self.cache) + len(seen) > self.LIMIT:
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2, None))
        missing = [c for c in seen if c not in self.cache]
        if missing:
            self._learn(missing)
        get = self.cache.__getitem__
        return [self._ids(t).tobytes() if odd else b"".join(map(get, c)) for t, odd, c in zip(texts, whole, chunks, strict=True)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; later tasks of the same worker find its cache filled."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _slices(batches, chars: int):
    """Lists of (ids, texts) with about so many characters each."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts.append(text.as_py() or "")
            ids.append(i)
            n += len(texts[-1])
            if n >= chars:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def write_token_files(
    spark: SparkSession,
    docs: DataFrame,
    out: str,
    vocabulary: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_chars: int = 1_000_000,
) -> dict:
    """Encodes docs and writes the files below ``out``; returns the manifest.

    One range exchange puts the documents in order; each task streams its range to files of its own
    under an attempt's name and renames them when whole, so that a repeated task does no harm. The
    driver sees one row of counts per part.
    """
    common.ship(spark)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("id", F.xxhash64("text"))
        .sortWithinPartitions("id", F.xxhash64("text"), "text")
    )

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        where, folder = common.filesystem(out)
        where.create_dir(folder, recursive=True)
        draft = f"{folder}/.part-{part:05d}-{attempt}"
        counts, ids, size = [], [], enc.dtype.itemsize
        with where.open_output_stream(f"{draft}.bin") as sink:
            for own, texts in _slices(batches, slice_chars):
                for raw in enc.encode(texts):
                    sink.write(raw)
                    sink.write(end)
                    counts.append(len(raw) // size + 1)
                ids += own
        if not counts:
            where.delete_file(f"{draft}.bin")
            return
        offsets = np.zeros(len(counts) + 1, "<i8")
        np.cumsum(counts, out=offsets[1:])
        with where.open_output_stream(f"{draft}.idx") as sink:
            sink.write(offsets.tobytes())
            sink.write(np.array([0 if i is None else i for i in ids], "<i8").tobytes())
            sink.write(np.array([i is None for i in ids], "u1").tobytes())
        for kind in ("bin", "idx"):
            where.move(f"{draft}.{kind}", f"{folder}/part-{part:05d}.{kind}")
        yield pa.record_batch([pa.array([part]), pa.array([len(ids)]), pa.array([int(offsets[-1])])], names=["part", "n_docs", "n_tokens"])

    rows = sorted(ordered.mapInArrow(common.lean(write), "part long, n_docs long, n_tokens long").collect())
    parts, base = [], 0
    for row in rows:
        parts.append({"part": row.part, "n_docs": row.n_docs, "n_tokens": row.n_tokens, "base": base})
        base += row.n_tokens
    manifest = {"width": encoder(vocabulary).dtype.itemsize, "end_id": end_id, "n_tokens": base, "parts": parts}
    where, folder = common.filesystem(out)
    where.create_dir(folder, recursive=True)
    common.write_json(f"{out}/manifest.json", manifest)
    return manifest


def open_part(out: str, manifest: dict, at: int):
    """(ids, local offsets, document ids, null flags) of one part, mapped."""
    import numpy as np

    entry = manifest["parts"][at]
    n, name = entry["n_docs"], f"{out}/part-{entry['part']:05d}"
    ids = common.array_file(f"{name}.bin", f"<u{manifest['width']}")
    raw = common.array_file(f"{name}.idx", "u1")
    offsets = np.frombuffer(raw, "<i8", n + 1)
    doc_ids = np.frombuffer(raw, "<i8", n, 8 * (n + 1))
    return ids, offsets, doc_ids, np.frombuffer(raw, "u1", n, 8 * (2 * n + 1))


READ_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids)."""
    common.ship(spark)
    n = len(common.read_json(f"{out}/manifest.json")["parts"])

    def read(batches):
        import pyarrow as pa

        manifest = common.read_json(f"{out}/manifest.json")
        for batch in batches:
            for at in batch.column(0).to_pylist():
                ids, offsets, doc_ids, nulls = open_part(out, manifest, at)
                base = manifest["parts"][at]["base"]
                bounds = offsets.tolist()
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch(
                    [
                        pa.array(doc_ids, mask=nulls.astype(bool)),
                        pa.array(offsets[:-1] + base),
                        pa.array(offsets[1:] - offsets[:-1]),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=READ_SCHEMA.names,
                )

    return spark.range(0, n, 1, max(1, n)).mapInArrow(common.lean(read), READ_SCHEMA)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, writes the files, and reports what the files hold."""
    out = common.work_path(spark, "token-ids")
    write_token_files(spark, common.table(spark, sf_dir, "documents"), out, common.tokenizer_file("byte_bpe_50k.json"))
    return read_token_files(spark, out)

"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to three machines over characters:

* the normaliser: the model's character map, longest source first, as arcs from source to replacement;
  a character without an arc stands for itself; a leading space, spaces as U+2581; dropped repeated
  spaces, where the model says so;
* the lexicon: a trie of the pieces with numbered states, whose accepting states go back to the root with
  the piece's id and weight;
* byte fallback: at the root, a character that is no piece gives the ids of its UTF-8 bytes.

They are composed with each input as it is read; the path of least weight in the tropical semiring is the
encoding. Unigram models weight a piece by its negative score. In merge (BPE) models a segmentation is
right if and only if merging each two neighbours' text by rank gives these two pieces back, so the lexicon
is also composed with an acceptor of pairs, whose states are the last piece: weight 0 for a pair that
holds, infinity for one that does not. All finite paths weigh 0 there, so the composition is determinised
as it is expanded: one of its states is the set of lexicon and pair states that a prefix leads to at weight
0, and an arc is worked out once for all inputs of the worker. At most one path ends at each place.

An input is cut where no piece has the two characters next to each other, which changes no path, and
parts are remembered by the worker; memory of parts, arcs and pairs is bounded, one long text included.
Null texts count as empty, which encodes to no ids. Rows may repeat; an empty table gives an empty result.
Only the id and text columns are read. A model that treats spaces as suffixes is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenids import _slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INFINITY = float("inf")

codecs.register_error("tallyweave.bytewise", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint(i):
        value = shift = 0
        while True:
            b = raw[i]
            i, value, shift = i + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, i

    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


def character_map(raw: bytes) -> dict[str, str]:
    """Source and replacement of each entry of a precompiled character map: a double-array trie and the replacements behind it."""
    import numpy as np

    if not raw:
        return {}
    (size,) = struct.unpack("<I", raw[:4])
    units, texts = np.frombuffer(raw, "<u4", size // 4, 4), raw[4 + size :]
    labels = np.arange(1, 256, dtype=np.uint32)

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    out, open_nodes = {}, [(b"", offset(int(units[0])))]
    while open_nodes:
        prefix, at = open_nodes.pop()
        places = at ^ labels
        inside = places < len(units)
        for label, place in zip(labels[inside].tolist(), places[inside].tolist(), strict=True):
            unit = int(units[place])
            if unit & 0x800000FF != label:
                continue
            source, node = prefix + bytes([label]), place ^ offset(unit)
            if unit & 256:
                begin = int(units[node]) & 0x7FFFFFFF
                out[source.decode()] = texts[begin : texts.index(b"\0", begin)].decode()
            open_nodes.append((source, node))
    return out


class Normaliser:
    """The first machine: arcs from sources to replacements; what has no arc is copied."""

    def __init__(self, arcs: dict[str, str], prefix: bool, squeeze: bool):
        self.single = str.maketrans({a: b for a, b in arcs.items() if len(a) == 1})
        self.longer: dict[str, list[str]] = {}
        for source in sorted((a for a in arcs if len(a) > 1), key=len, reverse=True):
            self.longer.setdefault(source[0], []).append(source)
        self.arcs, self.prefix, self.squeeze = arcs, prefix, squeeze

    def _replaced(self, text: str) -> str:
        if not self.longer or self.longer.keys().isdisjoint(text):
            return text.translate(self.single) if self.single else text
        out, i, n = [], 0, len(text)
        while i < n:
            source = next((x for x in self.longer.get(text[i], ()) if text.startswith(x, i)), text[i])
            out.append(self.arcs.get(source, source))
            i += len(source)
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self._replaced(text)
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""


class PieceModel:
    """The compiled machines of one model file."""

    #: Parts, and states of the composition, that a worker remembers.
    LIMIT = 300_000
    STATES = 250_000

    def __init__(self, model: str | bytes):
        if isinstance(model, str):
            with open(model, "rb") as source:
                model = source.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(24) or not normalizer.get(5, 1):
            raise ValueError("models that treat spaces as suffixes or keep them are not supported")
        self.merges = trainer.get(3, 1) == 2
        self.normalise = Normaliser(character_map(normalizer.get(2, b"")), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        self.ids = {p[0]: i for i, p in enumerate(self.pieces) if p[2] in (NORMAL, USER, UNUSED)}
        # the lexicon: arcs of each state by character, and the piece that ends there
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for text, i in self.ids.items():
            state = 0
            for c in text:
                after = self.arcs[state].get(c)
                if after is None:
                    after = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(-1)
                state = after
            self.ends[state] = i
        self.least = min((p[1] for p in self.pieces if p[2] == NORMAL), default=0.0)
        self.known = {c for t in self.ids for c in t}
        self.inside = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        spaced = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        #: Parts of a normalised text that no piece reaches across.
        self.part = re.compile(r"(?s).+") if spaced else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if "\n" not in self.known else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache: dict[str, bytes] = {}
        self.text = [self._surface(p) for p in self.pieces]
        self._forget()

    def _forget(self) -> None:
        """A composition with nothing but its first state: at the lexicon's root, no piece before."""
        self.pair: dict[tuple[int, int], float] = {}
        # a state is a tuple of pairs (lexicon state, piece before), each as one number
        self.width = len(self.pieces) + 1
        self.sets: list[tuple[int, ...]] = [(0,)]
        #: What ends in each state: the ids as bytes and the characters they stand for.
        self.output: list[tuple[bytes, int]] = [(b"", 0)]
        self.number: dict = {(self.sets[0], self.output[0]): 0}
        #: Arcs by state * 2**21 + character.
        self.delta: dict[int, int] = {}

    def forget(self) -> None:
        """Gives back what is remembered of inputs: a worker that waits for other stages' tasks keeps the compiled model alone."""
        self.cache = {}
        self._forget()

    def _surface(self, piece) -> bytes:
        text, _, kind = piece
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode()

    def _merged(self, text: str) -> list[str]:
        """The merges of a short text, best rank first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.pieces[i][1] > best):
                    best, at = self.pieces[i][1], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _weight(self, before: int, piece: int) -> float:
        """Weight of the pair acceptor's arc from a piece to the next; -1 is no piece, or one that cannot merge with it."""
        w = self.pair.get((before, piece))
        if w is None:
            b = self.pieces[piece][0]
            a = [self.pieces[before][0]] if before >= 0 else []
            w = self.pair[before, piece] = 0.0 if self._merged("".join([*a, b])) == [*a, b] else INFINITY
        return w

    def _fallback(self, c: str) -> list[int]:
        raw = c.encode("utf-8", "surrogatepass")
        return [self.bytes.get(b, self.unknown) for b in raw] if self.bytes else [self.unknown]

    def _expand(self, state: int, c: str) -> int:
        """The arc of the determinised composition from a state under a character."""
        after, output, here = [], (b"", 0), False
        for x in self.sets[state]:
            node, before = x // self.width, x % self.width - 1
            here = here or node == 0
            if node == 0 and before >= 0 and self.pieces[before][0][-1] + c not in self.inside:
                before = -1
            node = self.arcs[node].get(c, 0)
            if node:
                after.append(node * self.width + before + 1)
                piece = self.ends[node]
                if piece >= 0 and self._weight(before, piece) == 0.0:
                    output = (struct.pack("<i", piece), len(self.pieces[piece][0]))
                    last = piece
        if here and (c not in self.arcs[0] or self.ends[self.arcs[0][c]] < 0):
            ids = self._fallback(c)
            output, last = (struct.pack(f"<{len(ids)}i", *ids), 1), -1
        if output[1]:
            after.append(last + 1)
        key = (tuple(after), output)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.sets)
            self.sets.append(key[0])
            self.output.append(output)
        self.delta[state << 21 | ord(c)] = found
        return found

    def _merge_path(self, text: str) -> bytes:
        """Ids of the one finite path through the composition with a text."""
        if len(self.sets) > self.STATES or len(self.delta) > 4 * self.STATES or len(self.pair) > 4 * self.STATES:
            self._forget()
        state, path, delta = 0, [], self.delta
        for c in text:
            after = delta.get(state << 21 | ord(c))
            state = self._expand(state, c) if after is None else after
            path.append(state)
        out, at, output = [], len(path), self.output
        while at > 0:
            raw, n = output[path[at - 1]]
            out.append(raw)
            at -= n
        return b"".join(out[::-1])

    def _score_path(self, text: str) -> bytes:
        """Ids of the path of least weight through the composition with a text, by scores."""
        n, arcs, ends = len(text), self.arcs, self.ends
        weight, back = [0.0] + [INFINITY] * n, [(0, b"")] * (n + 1)
        for i in range(n):
            here = weight[i]
            if here == INFINITY:
                continue
            node, j = 0, i
            while j < n and (node := arcs[node].get(text[j], 0)):
                j += 1
                if ends[node] >= 0 and here - self.pieces[ends[node]][1] < weight[j]:
                    weight[j], back[j] = here - self.pieces[ends[node]][1], (i, struct.pack("<i", ends[node]))
            if text[i] not in arcs[0] or ends[arcs[0][text[i]]] < 0:
                # byte fallback, dearer than any piece
                w = here + 10.0 - self.least
                if w < weight[i + 1]:
                    ids = self._fallback(text[i])
                    weight[i + 1], back[i + 1] = w, (i, struct.pack(f"<{len(ids)}i", *ids))
        out, at = [], n
        while at > 0:
            at, raw = back[at]
            out.append(raw)
        return b"".join(out[::-1])

    def _learn(self, part: str) -> bytes:
        if len(self.cache) > self.LIMIT:
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2, None))
        raw = self._merge_path(part) if self.merges else self._score_path(part)
        if len(part) <= 64:
            self.cache[part] = raw
        return raw

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        parts = self.part.findall(self.normalise(text))
        try:
            return b"".join(map(self.cache.__getitem__, parts))
        except KeyError:
            learn = self._learn
            return b"".join([self.cache.get(p) or learn(p) for p in parts])

    def decode(self, ids: list[int]) -> str:
        """The inverse: surfaces of the pieces, bytes put together, the leading space taken away."""
        raw = b"".join(map(self.text.__getitem__, ids))
        text = raw.decode("utf-8", "tallyweave.bytewise")
        first = next((i for i in ids if self.pieces[i][2] != CONTROL), None)
        if self.normalise.prefix and first is not None and self.pieces[first][0].startswith(SPACE):
            text = text[1:]
        return text


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


SCHEMA = "doc_id long, n_ids long, ids array<int>, n_fallback long, decoded_sha256 string, round_trip boolean"


def encode_decode(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, how many of them are bytes, the digest of the ids decoded again, and whether that is the text."""
    common.ship(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = model(path)
        is_byte = np.array([p[2] == BYTE for p in own.pieces])
        try:
            for keys, texts in _slices(batches, 1_000_000):
                raws = [own.encode(t) for t in texts]
                ends = np.cumsum([0] + [len(r) // 4 for r in raws])
                flat = np.frombuffer(b"".join(raws), "<i4")
                fallback = np.concatenate([[0], np.cumsum(is_byte[flat])])
                values = flat.tolist()
                decoded = [own.decode(values[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                yield pa.record_batch(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                        pa.array(fallback[ends[1:]] - fallback[ends[:-1]], pa.int64()),
                        pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]),
                        pa.array([d == t for d, t in zip(decoded, texts, strict=True)]),
                    ],
                    names=["doc_id", "n_ids", "ids", "n_fallback", "decoded_sha256", "round_trip"],
                )
        finally:
            own.forget()

    return picked.mapInArrow(common.lean(run), SCHEMA)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return encode_decode(spark, common.table(spark, sf_dir, "documents"), common.tokenizer_file("piece_bpe_32k.model"))

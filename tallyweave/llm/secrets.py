"""Secret scan with a trigram inverted index.

Each rule's expression gives a Boolean trigram query. Texts are indexed in segments of bounded size
where they are read; postings are intersected, and only the candidates left are verified with the
expression. A rule without mandatory trigrams (the hex rule) scans its segment whole. Nothing is
shuffled: a segment's index serves that segment only, and a lost task builds it again.

Null texts count as empty; rows may repeat; an empty table gives an empty result. Only the id and text
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenids import _slices
from .trigrams import SegmentIndex, query_of, trigrams_in


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    accept: Callable[[re.Match], bool] = lambda m: True
    base: bool = False


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 8


def _at_least_16(m: re.Match) -> bool:
    return m.end() - m.start() >= 16


#: Base rules first, in the order in which ties are listed. A run of hex digits is as long as it gets, so {32,} drops just the short ones.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, _long_value, True),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, _at_least_16, True),
    Rule("hex", r"[0-9a-f]{32,}", re.ASCII, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", re.ASCII),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}", re.ASCII),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", re.ASCII),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", re.ASCII),
    Rule("url", r"://[A-Za-z0-9._~%-]{1,64}:[A-Za-z0-9._~%!$&*+-]{4,128}@[A-Za-z0-9]", re.ASCII),
)


class Scanner:
    """The rules with their queries and one index, for the segments of a task."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), query_of(r.pattern, r.flags)) for r in rules]
        self.index = SegmentIndex(set().union(*(trigrams_in(q) for _, _, q in self.rules)))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rank of the rule, end) of each text's secrets, ascending; positions are code points."""
        self.index.build([t.encode("utf-8", "surrogatepass") for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for rank, (rule, expression, query) in enumerate(self.rules):
            for at in self.index.candidates(query).tolist():
                for m in expression.finditer(texts[at]):
                    if rule.accept(m):
                        out[at].append((m.start(), rank, m.end()))
        for spans in out:
            spans.sort()
        return out


SCHEMA = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"


def find_secrets(spark: SparkSession, docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 2_000_000) -> DataFrame:
    """doc_id and the spans of secrets of every row of docs, by start, then in the order of the rules."""
    common.ship(spark)

    def scan(batches):
        import pyarrow as pa

        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for ids, texts in _slices(batches, slice_chars):
            spans = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in scanner.scan(texts)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(spans, kind)], names=["doc_id", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(common.lean(scan), SCHEMA)


def digest(spans, kinds: list[str] | None = None):
    """kind:start:end of the spans (of the kinds named), comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base rules, and all spans."""
    found = find_secrets(spark, common.table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(digest(F.col("spans"), base), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )

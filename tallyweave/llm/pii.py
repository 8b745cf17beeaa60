"""Personal data: generators propose spans, boosted trees select, base spans stay; DataFrame functions only.

Base generators (email, ip, card, phone) are exact rules whose spans are always kept. Three more propose
with high recall what the base misses: spelled-out addresses ("contact"), grouped numbers such as
national phone or social security numbers ("number"), and account numbers ("account"). Each proposal
gets format and context features; gradient-boosted trees, here nested conditions inside the plan, score
it; it is kept if its score reaches its kind's calibrated threshold and it overlaps no base span and no
better proposal.

The trees are fitted in the driver on EXAMPLES labelled spans: SAMPLE passages of the table's documents
(one for each bucket of text hashes, so the bound holds at every size), into which personal data and
look-alikes are written between words. A proposal that overlaps what was written has its label, what the
documents themselves hold besides base spans counts as wrong. Passages of three buckets in four train;
those of the fourth, held-out documents, set each kind's threshold at the least score from which at
least PRECISION of the proposals are right.

Positions are code points, ends exclusive. Null texts count as empty; rows may repeat; an empty table
gives an empty result; only the id and text columns are read, whatever the others are called. Work is in
proportion to a text's length and matches: expressions match in linear time, places and overlaps come
from block-wise prefix scans, and long texts are cut into chunks before anything is taken out of them.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .boosting import Boosted

EXAMPLES = 2_400
SAMPLE = 256
#: Characters of a passage.
PASSAGE = 300
PRECISION = 0.98
BLOCK = 64
CHUNK = 2_048
LATE = 2**31 - 1
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"


@dataclass(frozen=True)
class Generator:
    """A kind, its expression (Java), what a text must have to be tried, and what a match must be."""

    kind: str
    pattern: str
    gate: str
    base: bool = False


def _run(chars: str) -> str:
    return rf"(?:(?<![{chars}])|\G)[{chars}]++"


GENERATORS = (
    Generator("email", _run("A-Za-z0-9._%+-") + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Generator("ip", _run("0-9") + r"(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", True),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", True),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True),
    Generator("contact", _run("A-Za-z0-9._%+-") + r"\x20?(?:[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\x20dot\x20|\.)\x20?[A-Za-z]{2,24})++", r"[(\[]at[)\]]|\bat\b.{1,80}\bdot\b"),
    Generator("number", r"(?<![0-9A-Za-z.,+-])\(?[0-9]{2,5}\)?(?:[\x20.-]{1,2}[0-9]{2,5}){1,5}+(?![0-9A-Za-z])", "[0-9]"),
    Generator("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}"),
)
BASE = tuple(g.kind for g in GENERATORS if g.base)
KINDS = tuple(g.kind for g in GENERATORS)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, step: Callable[[Column, Column], Column], start: int) -> Column:
    """For each place of an array of ints what step makes of all values before it: within its block, on top of the blocks before."""
    first = F.lit(start)

    def with_bases(bases: Column) -> Column:
        return F.transform(values, lambda v, i: F.aggregate(F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.get(bases, F.floor(i / BLOCK).cast("int")), step))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), first, step))
    bases = F.aggregate(blocks, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    return F.when(F.size(values) > 0, _let(bases, with_bases)).otherwise(values)


def _plus(x: Column, y: Column) -> Column:
    return x + y


def _most(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))


def _taken(chunks: Column, a: Column, b: Column) -> Column:
    """The characters from a to b, b exclusive, of a text in chunks."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    across = F.concat(F.substring(at(i), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), b % CHUNK))
    return F.when(i == j, F.substring(at(i), a % CHUNK + 1, b - a)).otherwise(across)


def proposals(text: Column, generator: Generator) -> Column:
    """Leftmost non-overlapping matches that hold, with their places: what lies between matches gives the starts."""
    rank = KINDS.index(generator.kind)
    pieces = F.split(text, generator.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(generator.pattern), F.lit(0))
    zipped = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("gap"), m.alias("match")))

    def placed(z: Column) -> Column:
        lengths = F.transform(z, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))

        def spans(starts: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.length(x["gap"])
                end = start + F.coalesce(F.length(x["match"]), F.lit(0))
                return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(generator.kind).alias("kind"), x["match"].alias("match"))

            return F.filter(F.transform(z, one), lambda x: x["match"].isNotNull() & _valid(generator.kind, x["match"]))

        return _let(lengths, lambda n: _let(_scan(n, _plus, 0), spans))

    return F.when(text.rlike(generator.gate), _let(zipped, placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


FEATURES = ("rank", "length", "digits", "groups", "letters", "parens", "shape_phone", "shape_social", "shape_date", "luhn", "word_before", "money_before", "cue", "against", "close")
_CUES = r"(?i)(?:tel|phone|call|fax|mobile|cell|mail|contact|reach|write|ssn|social|iban|account|konto|cuenta|compte)[^0-9]{0,12}$"
_AGAINST = r"(?i)(?:version|isbn|page|pp|order|invoice|ref|part|serial|section|year|no|nr|vol|build|rev)[^0-9A-Za-z]{0,3}$"


def _features(chunks: Column, x: Column) -> Column:
    m = x["match"]
    # 24 characters of context before, one after
    before = _taken(chunks, F.greatest(x["start"] - 24, F.lit(0)), x["start"])
    after = _taken(chunks, x["end"], x["end"] + 1)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    digits = _digits(m)
    values = {
        "rank": x["rank"].cast("double"),
        "length": F.length(m).cast("double"),
        "digits": F.length(digits).cast("double"),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        "parens": flag(m.rlike(r"[(\[]")),
        "shape_phone": flag(m.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")),
        "shape_social": flag(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "shape_date": flag(m.rlike(r"^(?:(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|[0-3]?[0-9][ .-][01]?[0-9][ .-](?:19|20)?[0-9]{2})$")),
        "luhn": flag(F.length(digits).between(2, 19) & F.call_function("luhn_check", digits)),
        "word_before": flag(before.rlike(r"[A-Za-z:]\x20?$")),
        "money_before": flag(before.rlike("[$€£#]\\x20?$")),
        "cue": flag(before.rlike(_CUES)),
        "against": flag(before.rlike(_AGAINST)),
        "close": flag((after == "") | after.rlike(r"[\s.,;)]")),
    }
    return F.struct(*(values[name].alias(name) for name in FEATURES))


# What is written into passages; d is a digit, A a capital, w a letter, other words stand for themselves.
YES = ("(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "ddd-dd-dddd", "dd dd dd dd dd", "0dd dddd dddd", "wwww at wwwww dot com", "www.ww (at) wwwww (dot) org", "www [at] wwwww.net", "AAdd dddd dddd dddd dddd dd", "AAdd AAAA dddd dddd dddd", "AAdddddddddddddddddd")
NO = ("20dd-0d-1d", "1d.0d.20dd", "19dd-20dd", "dd.dd", "ddd.dd", "d.dd.ddd", "ddd-d-dddd-dddd-d", "dddd-dddd", "dd-dd", "dd 000", "dd.ddd.ddd", "dd dd", "ddd ddd", "www at dd dot ww", "looked at ww dot ww", "AAdd AAAA AAAA", "AAdd dddd dddd", "dddd.dd.dd", "dddd dddd dddd dddd dddd")
FOR_YES = ("call ", "Tel: ", "phone ", "reach me: ", "fax ", "contact ", "SSN ", "IBAN ", "account ", "write to ", "my number is ", "")
FOR_NO = ("version ", "ISBN ", "pages ", "order ", "invoice ", "$", "€ ", "section ", "about ", "from ", "built ", "ref ", "", "year ", "was ")
_LITERAL = ("at", "dot", "com", "org", "net", "looked", "(at)", "(dot)", "[at]")


def _examples(passages: list[str]) -> list[dict]:
    """Passages with something written between two words: id, text, begin and end of it, whether it is personal data, and whether it is held out."""
    r = random.Random(11)
    marks = {"d": lambda: str(r.randrange(10)), "A": lambda: chr(65 + r.randrange(26)), "w": lambda: chr(97 + r.randrange(26))}
    passages = passages if len(passages) >= 8 else [*passages, *("so", "and then", "it was", "we saw that", "they said so", "here it is", "not much more", "as before")]
    rows = []
    for i in range(EXAMPLES):
        good, at = i % 2, r.randrange(len(passages))
        made = " ".join(part if part in _LITERAL else "".join(marks[c]() if c in marks else c for c in part) for part in r.choice(YES if good else NO).split(" "))
        # one example in ten has the other side's context, so that the format has to count too
        cue = r.choice(FOR_YES if good != (r.random() < 0.1) else FOR_NO)
        words = passages[at].split(" ")
        cut = r.randrange(len(words) + 1)
        left = " ".join([*words[:cut], cue])
        rows.append({"id": i, "text": left + made + r.choice((" ", ". ", ", ", "")) + " ".join(["", *words[cut:]]), "begin": len(left), "end": len(left) + len(made), "good": good, "held": at % 4 == 3})
    return rows


@dataclass(frozen=True)
class Selector:
    trees: Boosted
    thresholds: dict[str, float]
    held_out: dict[str, tuple[int, float, float]]


def _passages(docs: DataFrame, text_col: str) -> list[str]:
    """At most SAMPLE passages: of each bucket of text hashes the text with the least, from a place that the hash picks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).filter("text <> ''")
    place = F.expr("CAST(pmod(shiftrightunsigned(h, 9), length(text)) AS INT) + 1")
    taken = hashed.groupBy(F.pmod("h", F.lit(SAMPLE)).alias("bucket")).agg(F.min(F.struct("h", F.substring("text", place, F.lit(PASSAGE)).alias("passage"))).alias("least"))
    return [r.passage for r in taken.select("bucket", "least.passage").orderBy("bucket").collect()]


def selector(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> Selector:
    """The trees and thresholds fitted on passages of docs; one table gives one selector."""
    import numpy as np

    examples = _examples(_passages(docs, text_col))
    schema = "array<struct<id:int,text:string,begin:int,end:int,good:int,held:boolean>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples)), schema)).alias("e")).select("e.*")
    text = F.col("text")
    base = F.concat(*(proposals(text, g) for g in GENERATORS if g.base))
    more = F.concat(*(proposals(text, g) for g in GENERATORS if not g.base))
    staged = table.select("*", base.alias("base"), more.alias("more")).select("*", _chunks(text).alias("chunks"), F.explode(_apart(F.col("base"), F.col("more"))).alias("x"))
    label = F.when((F.col("x.start") < F.col("end")) & (F.col("begin") < F.col("x.end")), F.col("good")).otherwise(0)
    rows = staged.select("id", "held", label.alias("good"), F.col("x.kind").alias("kind"), F.col("x.start").alias("start"), _features(F.col("chunks"), F.col("x")).alias("f")).collect()
    rows.sort(key=lambda r: (r.id, r.f.rank, r.start))
    x = np.array([tuple(r.f) for r in rows])
    y = np.array([r.good for r in rows])
    test = np.array([r.held for r in rows])
    trees = Boosted.fit(x[~test], y[~test], FEATURES)
    scores, thresholds, held_out = trees.scores(x), {}, {}
    for kind in KINDS[len(BASE) :]:
        own = test & np.array([r.kind == kind for r in rows])
        order = np.argsort(-scores[own], kind="stable")
        s, right = scores[own][order], np.cumsum(y[own][order])
        precision = right / np.arange(1, len(s) + 1)
        last = np.append(s[1:] < s[:-1], True)
        good = np.flatnonzero((precision >= PRECISION) & last[: len(s)])
        if len(good):
            thresholds[kind] = float(s[good[-1]])
            held_out[kind] = (int(own.sum()), float(precision[good[-1]]), float(right[good[-1]] / max(1, y[own].sum())))
    return Selector(trees, thresholds, held_out)


def _apart(base: Column, more: Column) -> Column:
    """The spans of more that overlap none of base, by start."""
    entry = lambda own: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), x.alias("x"))

    def judged(every: Column) -> Column:
        ends = F.transform(every, lambda e: F.when(e["own"], F.lit(-1)).otherwise(e["end"]))
        starts = F.reverse(F.transform(every, lambda e: F.when(e["own"], F.lit(LATE)).otherwise(e["start"])))

        def kept(reach: Column) -> Column:
            # base spans that begin before end by reach.left, those that begin after start from reach.right
            free = lambda e, i: F.when(e["own"] & (F.get(reach["left"], i) <= e["start"]) & (F.get(reach["right"], i) >= e["end"]), e["x"])
            return F.filter(F.transform(every, free), lambda x: x.isNotNull())

        left, right = _let(ends, lambda v: _scan(v, _most, -1)), F.reverse(_let(starts, lambda v: _scan(v, _least, LATE)))
        return _let(F.struct(left.alias("left"), right.alias("right")), kept)

    every = F.array_sort(F.concat(F.transform(base, entry(False)), F.transform(more, entry(True))))
    return F.when(F.size(more) > 0, _let(every, judged)).otherwise(F.array().cast(SPAN))


def _groups(ends: Column, starts: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """body(reach, first, last) of spans by start: the farthest end before each, and the first and last place of its group of overlapping spans."""

    def with_reach(own: Column) -> Column:
        reach = own["reach"]
        begins = F.zip_with(reach, own["starts"], lambda m, s: m <= s)
        begins = F.transform(begins, lambda new, i: F.when(new, i))

        def bounds(b: Column) -> Column:
            first = _let(F.transform(b, lambda x: F.coalesce(x, F.lit(0))), lambda v: F.zip_with(b, _scan(v, _most, 0), lambda own, before: F.coalesce(own, before)))
            nexts = F.reverse(_let(F.reverse(F.transform(b, lambda x: F.coalesce(x, F.lit(LATE)))), lambda v: _scan(v, _least, LATE)))
            return _let(F.struct(first.alias("first"), F.transform(nexts, lambda x: F.least(x, F.size(b)) - 1).alias("last")), lambda t: body(reach, t["first"], t["last"]))

        return _let(begins, bounds)

    reach = _let(ends, lambda v: _scan(v, _most, -1))
    return _let(F.struct(reach.alias("reach"), starts.alias("starts")), with_reach)


def found(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, spans): each row of docs as one struct, its text, and all kept spans by (start, rank)."""
    chosen = selector(spark, docs, text_col)
    text = F.col("text")
    picked = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast(SPAN)
    more = [proposals(text, g) for g in GENERATORS if g.kind in chosen.thresholds]
    staged = picked.select("row", "text", F.concat(*(proposals(text, g) for g in GENERATORS if g.base)).alias("base"), (F.concat(*more) if more else none).alias("more"))
    staged = staged.select("row", "text", "base", _apart(F.col("base"), F.col("more")).alias("more"))
    least = F.create_map(*(v for k, t in (chosen.thresholds or {"": 0.0}).items() for v in (F.lit(k), F.lit(t))))

    def scored(chunks: Column) -> Column:
        return F.transform("more", lambda x: F.struct(x.alias("x"), _let(_features(chunks, x), chosen.trees.column).alias("score")))

    enough = F.filter(_let(_chunks(text), scored), lambda s: s["score"] >= least[s["x"]["kind"]])
    staged = staged.select("row", "text", "base", F.when(F.size("more") > 0, enough).alias("scored"))
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["x"]["start"] < b["x"]["start"]) | ((a["x"]["start"] == b["x"]["start"]) & (a["x"]["rank"] < b["x"]["rank"]))))
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def best(reach: Column, first: Column, last: Column) -> Column:
        own = F.col("scored")

        def kept(s: Column, i: Column) -> Column:
            group = F.slice(own, F.get(first, i) + 1, F.get(last, i) - F.get(first, i) + 1)
            return F.when(~F.exists(group, lambda o: better(o, s) & overlap(o["x"], s["x"])), s["x"])

        return F.filter(F.transform(own, kept), lambda x: x.isNotNull())

    chosen_ones = _groups(F.transform("scored", lambda s: s["x"]["end"]), F.transform("scored", lambda s: s["x"]["start"]), best)
    added = F.when(F.size("scored") > 1, chosen_ones).when(F.size("scored") == 1, F.transform("scored", lambda s: s["x"])).otherwise(none)
    return staged.select("row", "text", F.array_sort(F.concat("base", added)).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every kept span replaced by its kind in brackets; overlapping spans become one mark. Null texts stay null."""
    own = F.col("spans")

    def filled(chunks: Column) -> Column:
        def pieces(reach: Column, first: Column, last: Column) -> Column:
            mark = lambda x, i: F.when(
                F.get(first, i) == i, F.concat(_taken(chunks, F.greatest(F.get(reach, i), F.lit(0)), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
            )
            tail = _taken(chunks, F.array_max(F.transform(own, lambda x: x["end"])), F.length("text"))
            return F.concat(F.array_join(F.transform(own, mark), ""), tail)

        return _groups(F.transform(own, lambda x: x["end"]), F.transform(own, lambda x: x["start"]), pieces)

    made = F.when(F.size(own) > 0, _let(_chunks(F.col("text")), filled)).otherwise(F.col("row")[text_col])
    return found(spark, docs, text_col).select(*(made.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base kinds, and all spans."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = found(spark, docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return every.select(
        F.col("row.doc_id").alias("doc_id"),
        *map(count, BASE),
        F.sha2(digest(F.filter("spans", lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )

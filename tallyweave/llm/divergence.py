"""How far the sources of each language differ in their terms, exactly, by a heavy-light split.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case. A language keeps the V terms
that at least MIN_DOCS of its documents have. A group is a (lang, source) that occurs, with or without
terms; a language as a whole is counted in the same way. A kept term with n occurrences among the group's N
has p = 1 + floor(SCALE * (n + 2) / (N + 2 * V)); two such values differ by f = floor((p - q)^2 / (p + q)).

1. One pass over the texts counts terms within tasks, then over all by (lang, source, term).
2. A term is heavy if at least one in DENSE of its language's groups have it. Terms go to blocks and groups
   to tiles, both by hash. A task has two tiles and one block, so its rows are bounded whatever their number.
3. Every two groups start from V * f of their values for no occurrence. Heavy terms of the block fill a
   numpy array, group by term, and add what their sum differs by. Light terms stay postings: what one
   posting changes against all groups of the other tile, plus what two postings of one term change on
   top. All is integers, so the parts add up exactly in any order.
4. Ranks are row numbers within a group, over as many rows as its language has sources, or over its terms,
   of which each task passes on only the first TOP.

Null text, lang and source are empty. A language without kept terms gives pairs of value 0, a language of
one source no pairs, an empty table no rows. Repeated rows count each. Only the three columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
DENSE = 4
#: Terms of a block and groups of a tile, on average.
TERMS = 256
GROUPS = 128
#: Distinct terms that a task counts before it passes them on.
HELD = 300_000
#: Most groups or languages that are broadcast.
BROADCAST_GROUPS = 20_000


def term_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, docs, n) of docs (lang, source, text).

    Documents with a term are counted by language in rows without a source; rows without a term name groups.
    """
    common.ship(spark)
    letters = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c > 127)
    plain = bytes(c if c in letters else 32 for c in range(256)).lower()

    def rows(occurrences, spread, groups):
        import pyarrow as pa

        def batch(lang, source, terms, docs, n):
            size = len(terms)
            return pa.record_batch(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())],
                names=["lang", "source", "term", "docs", "n"],
            )

        for (lang, source), counter in occurrences.items():
            terms, n = list(counter), list(counter.values())
            for k in range(0, len(terms), 50_000):
                yield batch(lang, source, terms[k : k + 50_000], [0] * len(terms[k : k + 50_000]), n[k : k + 50_000])
        for lang, counter in spread.items():
            terms, n = list(counter), list(counter.values())
            for k in range(0, len(terms), 50_000):
                yield batch(lang, None, terms[k : k + 50_000], n[k : k + 50_000], [0] * len(terms[k : k + 50_000]))
        for lang, source in groups:
            yield batch(lang, source, [None], [0], [0])

    def run(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa

        occurrences, spread, groups, held = defaultdict(Counter), defaultdict(Counter), set(), 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
                groups.add((lang, source))
                terms = (text.as_py() or b"").translate(plain).split()
                for counter, found in ((occurrences[lang, source], terms), (spread[lang], set(terms))):
                    before = len(counter)
                    counter.update(found)
                    held += len(counter) - before
                if held >= HELD:
                    yield from rows(occurrences, spread, ())
                    occurrences, spread, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows(occurrences, spread, groups)

    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(empty).mapInArrow(common.lean(run), "lang string, source string, term string, docs long, n long")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)) of named columns, exact; 1 for a language without terms."""
    whole = F.expr(f"CAST({n} + 2 AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0)) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")
    return F.when(F.col(terms) > 0, 1 + whole).otherwise(F.lit(1)).cast("long")


def differ(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of named columns that hold shares."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _f(x, y):
    d = x - y
    return d * d // (x + y)


def tile_sums(table):
    """(lang, a, b, value): what one block of terms adds to each two groups a < b of two tiles.

    Rows without a term name the groups and their share of no occurrence (base); on one block they count the
    language's terms (terms), which every two groups start from. The others are occurrences, with their share.
    """
    import numpy as np
    import pyarrow as pa

    col = {n: table.column(n).to_numpy(zero_copy_only=False) for n in ("source", "tile", "term", "heavy", "share", "base", "terms")}
    lang, left, right = (table.column(n)[0].as_py() for n in ("lang", "x", "y"))
    names, source = np.unique(col["source"], return_inverse=True)
    named = np.array([t is None for t in col["term"]])
    tile, base = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    tile[source[named]], base[source[named]] = col["tile"][named], col["base"][named]
    sides = [np.flatnonzero(tile == left), np.flatnonzero(tile == right)]
    bases = [base[s] for s in sides]
    total = int(col["terms"][named].max()) * _f(bases[0][:, None], bases[1][None, :])
    _, term = np.unique(col["term"][~named], return_inverse=True)
    source, heavy, value = source[~named], col["heavy"][~named].astype(bool), col["share"][~named].astype(np.int64)

    place = np.zeros(len(names), np.int64)
    dense, light = [], []
    for s, b in zip(sides, bases, strict=True):
        place[:] = -1
        place[s] = np.arange(len(s))
        own = place[source] >= 0
        some, terms = own & heavy, np.unique(term[heavy])
        array = np.repeat(b[:, None], len(terms), axis=1)
        array[place[source[some]], np.searchsorted(terms, term[some])] = value[some]
        dense.append(array)
        some = own & ~heavy
        ranks = np.argsort(term[some], kind="stable")
        light.append((term[some][ranks], place[source[some]][ranks], value[some][ranks]))

    # heavy terms: all groups against all, by one group of the first tile at a time
    for k in range(len(sides[0])):
        total[k] += _f(dense[0][k][None, :], dense[1]).sum(axis=1) - dense[0].shape[1] * _f(bases[0][k], bases[1])

    # light terms: one posting against groups without the term; equal ones of a group are counted once
    for flip in (0, 1):
        _, at, share_ = light[flip]
        pairs, times = np.unique(np.stack([at, share_]), axis=1, return_counts=True)
        sums, mine, other = total if flip == 0 else total.T, bases[flip], bases[1 - flip]
        for k in range(0, len(times), 2048):
            g, p = pairs[:, k : k + 2048]
            np.add.at(sums, g, times[k : k + 2048, None] * (_f(p[:, None], other[None, :]) - _f(mine[g][:, None], other[None, :])))

    # light terms: two postings of one term, on top of what each of them has changed
    (ta, ga, pa_), (tb, gb, pb) = light
    low, high = np.searchsorted(tb, ta), np.searchsorted(tb, ta, "right")
    ends = np.cumsum(high - low)
    start = 0
    while start < len(ta):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 1_000_000, "right")))
        n = (high - low)[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
        p, q, b, c = pa_[i], pb[j], bases[0][ga[i]], bases[1][gb[j]]
        np.add.at(total, (ga[i], gb[j]), _f(p, q) - _f(p, c) - _f(b, q) + _f(b, c))
        start = stop

    a, b = np.nonzero(np.ones_like(total, bool) if left != right else np.triu(np.ones_like(total, bool), 1))
    first, second = names[sides[0][a]], names[sides[1][b]]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(first.tolist(), pa.string()), "b": pa.array(second.tolist(), pa.string()), "value": pa.array(total[a, b])})


def _few(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def _pairs(spark: SparkSession, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every group and every other source of its language."""

    def tiled(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
        spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        return spread.withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other"))

    none = F.lit(0).cast("long")
    occurrences = kept.select("lang", "source", "tiles", F.pmod(F.xxhash64("term", F.lit(0)), "blocks").alias("block"), "term", (F.col("spread") * DENSE >= F.col("sources")).alias("heavy"), "share", none.alias("base"), none.alias("terms"))
    names = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    names = names.select("lang", "source", "tiles", "block", F.lit(None).cast("string").alias("term"), F.lit(False).alias("heavy"), none.alias("share"), "base", F.when(F.col("block") == 0, F.col("terms")).otherwise(F.lit(0)).alias("terms"))
    rows = tiled(occurrences.unionByName(names)).select("lang", "x", "y", "block", "source", "tile", "term", "heavy", "share", "base", "terms")
    sums = rows.groupBy("lang", "x", "y", "block").applyInArrow(tile_sums, "lang string, a string, b string, value long")
    both = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return both.select("lang", "value", turned.alias("p")).select("lang", "p.source", "p.item", "value")


def divergence(spark: SparkSession, docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source (part pair) and the first TOP terms (part term)."""
    with common.Scratch(spark) as tables:
        counts = term_counts(spark, docs).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        counts = tables.written(counts, "counts")
        of_term = Window.partitionBy("lang", "term")
        seen = counts.filter("term IS NOT NULL").select(
            "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("in_lang"), F.count("source").over(of_term).alias("spread"), (F.min("source").over(of_term) == F.col("source")).alias("first")
        )
        kept = tables.written(seen.filter(f"docs >= {least} AND source IS NOT NULL").drop("docs"), "kept")
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
        groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
        groups = tables.written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("firsts", F.lit(0)).alias("firsts")), "groups")
        langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
        langs = langs.withColumns({"blocks": F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)), "tiles": F.ceil(F.col("sources") / GROUPS)})
        groups = groups.join(_few(langs), "lang").withColumn("none", F.lit(0).cast("long")).withColumn("base", share("none", "total", "terms"))
        groups = tables.written(groups.drop("none", "firsts"), "shares")
        shares = kept.join(_few(groups), ["lang", "source"]).withColumns({"share": share("n", "total", "terms"), "lang_share": share("in_lang", "lang_total", "terms")})
        shares = tables.written(shares.drop("base"), "kept-shares")

        pairs = _pairs(spark, shares, groups)
        pairs = tables.written(pairs, "pairs")
        ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
        terms = shares.filter("share > lang_share").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ("share", "lang_share").alias("value"))
        terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= TOP)
        return common.written(spark, pairs.unionByName(terms), "divergence")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence(spark, common.table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS MATERIALIZED (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS MATERIALIZED (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS MATERIALIZED (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS MATERIALIZED (
  SELECT s.lang, s.source, coalesce(t.total, 0) AS total, coalesce(v.terms, 0) AS terms
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON s.lang = t.lang AND s.source = t.source
  LEFT JOIN v ON s.lang = v.lang
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, k.in_lang, coalesce(c.n, 0) AS n, g.terms,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * g.terms) AS p,
         1 + (1000000000 * (k.in_lang + 2)::HUGEINT) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) + 2 * g.terms) AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (
    SELECT a.lang, a.source AS a, b.source AS b, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) s ON s.lang = x.lang AND s.a = x.source AND s.b = y.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), u AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM u WHERE part = 'pair' OR rank <= 10
"""

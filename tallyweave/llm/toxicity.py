"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight per term is shared by all ordered thresholds, and a
text's score is its expected grade, 0 to 3. Features are the distinct words of the whole text. The fit
uses at most MAX_ROWS labelled documents, those with the smallest hashes of their ids, and all terms in at
least MIN_ROWS of them; an L1 penalty leaves the weights of a few terms. Everything is in id order, so
that a table gives one model.

Grades come from the labels alone: 0, no label of a document says toxic; 1, its labels disagree; 2, all
say toxic and one calls it good; 3, all say toxic and none calls it good. Grades that no label gives get
no share of their own. The decision threshold on P(grade >= 1) is set on documents that a fit left out,
vocabulary included, each third of them in turn; the final fit takes all. The penalty falls with the
square root of the number of documents.

Null texts count as empty and get the score of a text without known terms. Labels without an id or a
toxic value are left out; without quality they call nothing good. Of several texts of a labelled id the
one with the least hash counts. Without usable labels, or with labels of one kind, all weights are zero
and nothing is toxic. Rows may repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenids import _slices

MAX_ROWS = 8_000
MIN_ROWS = 3
LEVELS = 3
PENALTY = 0.036
FOLDS = 3
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    """Weights by term, ascending thresholds, and the probability from which a text is toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (30.0, 31.0, 32.0)
    cut: float = 0.5
    held_out: dict[str, float] = field(default_factory=dict)

    def above(self, score):
        """P(grade >= k) for k = 1, 2, 3."""
        import numpy as np

        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds) - score, -500, 500)))


def _fit(x_rows, n_terms: int, grades, levels: int = LEVELS, penalty: float | None = None, steps: int = 400, settled: float = 1e-7):
    """Weights and thresholds by accelerated proximal gradient on the whole sample, until ten steps in a row gain next to nothing."""
    import numpy as np

    n = len(x_rows)
    penalty = PENALTY / n**0.5 if penalty is None else penalty
    rows = np.repeat(np.arange(n), [len(r) for r in x_rows])
    cols = np.concatenate([np.asarray(r, np.int64) for r in x_rows]) if len(rows) else np.zeros(0, np.int64)
    y = np.asarray(grades)
    share = np.clip([(y >= k).mean() for k in range(1, levels + 1)], 1e-4, 1 - 1e-4)
    theta = np.log((1 - share) / share)
    w = np.zeros(n_terms)
    look_w, look_t, pace, rate = w.copy(), theta.copy(), 1.0, 1.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def slope(w, theta):
        f = np.bincount(rows, w[cols], n)
        low = np.where(y == 0, -np.inf, theta[np.clip(y - 1, 0, None)])
        high = np.where(y == levels, np.inf, theta[np.clip(y, None, levels - 1)])
        a, b = sigmoid(low - f), sigmoid(high - f)
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        g_f = (db - da) / n
        g_t = np.zeros(levels)
        np.add.at(g_t, np.clip(y - 1, 0, None), np.where(y > 0, da, 0) / n)
        np.add.at(g_t, np.clip(y, None, levels - 1), np.where(y < levels, -db, 0) / n)
        return np.bincount(cols, g_f[rows], n_terms), g_t, -np.log(p).mean()

    reached, idle = np.inf, 0
    for _ in range(steps):
        g_w, g_t, loss = slope(look_w, look_t)
        while True:
            next_w = look_w - rate * g_w
            next_w = np.sign(next_w) * np.maximum(np.abs(next_w) - rate * penalty, 0)
            next_t = np.sort(look_t - rate * g_t)
            next_t = np.maximum.accumulate(next_t + 1e-6 * np.arange(levels))
            d_w, d_t = next_w - look_w, next_t - look_t
            reach = loss + d_w @ g_w + d_t @ g_t + (d_w @ d_w + d_t @ d_t) / (2 * rate)
            there = slope(next_w, next_t)[2]
            if there <= reach + 1e-10 or rate < 1e-4:
                break
            rate /= 2
        now = there + penalty * np.abs(next_w).sum()
        idle = idle + 1 if abs(reached - now) < settled else 0
        reached = now
        if idle == 10:
            return next_w, next_t
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        look_w = next_w + (pace - 1) / after * (next_w - w)
        look_t = np.sort(next_t + (pace - 1) / after * (next_t - theta))
        w, theta, pace, rate = next_w, next_t, after, rate * 1.2
    return w, theta


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, toxic, and quality if there is one)."""
    good = F.coalesce(F.col("quality").cast("double") > 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
    votes = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("double") > 0).alias("bad"), good.alias("good")).dropna()
    told = votes.groupBy("doc_id").agg(F.max("bad").alias("any"), F.min("bad").alias("all"), F.max("good").alias("good"))
    return told.select("doc_id", F.when(~F.col("any"), 0).when(~F.col("all"), 1).when(F.col("good"), 2).otherwise(3).alias("grade"))


def _sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, grade, terms: distinct words) of the labelled documents that the fit uses, at most max_rows."""
    chosen = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most max_rows rows of two numbers: safe to broadcast
    picked = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            terms = [sorted(set(words(t.as_py()))) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("grade"), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "grade", "terms"])

    return common.written(spark, picked.select("doc_id", "grade", "one.text").mapInArrow(common.lean(split), "doc_id long, grade int, terms array<string>"), "toxicity-sample")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, min_rows: int = MIN_ROWS) -> Model:
    """The model of the labelled rows of docs."""
    import numpy as np

    common.ship(spark)
    sample = _sample(spark, docs, labels, max_rows)
    stats = sample.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).select("term").orderBy("term")
    terms = [r.term for r in stats.collect()]
    vocabulary = {t: i for i, t in enumerate(terms)}

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            known = [[vocabulary[t] for t in ts if t in vocabulary] for ts in batch.column("terms").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("grade"), pa.array(known, pa.list_(pa.int32()))], names=["doc_id", "grade", "terms"])

    rows = sorted(sample.mapInArrow(common.lean(encode), "doc_id long, grade int, terms array<int>").collect())
    grades = np.array([r.grade for r in rows], int)
    toxic = grades > 0
    if not rows or toxic.min() == toxic.max():
        return Model()
    x = [np.array(sorted(r.terms), np.int64) for r in rows]

    def weights(own):
        """Fitted on these rows: terms that too few of them have get no weight."""
        met = np.bincount(np.concatenate([x[i] for i in own]), minlength=len(terms)) if len(own) else np.zeros(len(terms), int)
        place = np.where(met >= min_rows, np.cumsum(met >= min_rows) - 1, -1)
        present = np.unique(grades[own])
        if len(present) < 2:
            return np.zeros(len(terms)), np.where(np.arange(1, LEVELS + 1) <= present.max(initial=0), -30.0, 30.0)
        w, steps = _fit([place[x[i]][place[x[i]] >= 0] for i in own], int((met >= min_rows).sum()), np.searchsorted(present, grades[own]), len(present) - 1)
        # a grade that no row has shares the threshold of the next one, and is out of reach behind the last
        at = np.searchsorted(present, np.arange(1, LEVELS + 1)) - 1
        theta = np.where(at < 0, steps[0] - 30.0, np.append(steps, steps[-1] + 30.0)[np.minimum(at, len(steps))])
        full = np.zeros(len(terms))
        full[met >= min_rows] = w
        return full, theta

    scale, every = np.zeros(len(rows)), np.arange(len(rows))
    for fold in range(FOLDS):
        test, train = every[fold::FOLDS], every[every % FOLDS != fold]
        w, theta = weights(train)
        scale[test] = np.array([w[x[i]].sum() for i in test]) - theta[0]
    # the cut with the most right answers; of several, the middle one on the scale of the log-odds
    values = np.unique(scale)
    middles = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    order = np.sort(scale[~toxic]), np.sort(scale[toxic])
    right = np.searchsorted(order[0], middles) + len(order[1]) - np.searchsorted(order[1], middles)
    best = middles[right == right.max()]
    cut = best[len(best) // 2]
    w, theta = weights(every)
    final = Model({terms[i]: float(w[i]) for i in np.flatnonzero(w)}, tuple(map(float, theta)), float(1 / (1 + np.exp(-np.clip(cut, -500, 500)))))
    final.held_out = {"rows": len(rows), "accuracy": float(((scale >= cut) == toxic).mean())}
    return final


SCHEMA = "doc_id long, severity double, p_toxic double, grade int, toxic int"


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected grade, P(grade >= 1), likeliest grade, and the decision, for every row."""
    common.ship(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for ids, texts in _slices(batches, 1_000_000):
            out = [_verdict(model, t) for t in texts]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int32(), pa.int32())))],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return picked.mapInArrow(common.lean(run), SCHEMA)


def _verdict(model: Model, text: str) -> tuple[float, float, int, int]:
    weights = model.weights
    p = model.above(sum(weights[t] for t in sorted(weights.keys() & set(words(text)))) if weights else 0.0)
    shares = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
    return float(p.sum()), float(p[0]), int(max(range(4), key=lambda k: shares[k])), int(bool(weights) and p[0] >= model.cut)


def clean_rows(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not toxic, all columns kept."""
    common.ship(spark)
    place = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            toxic = [_verdict(model, t.as_py() or "")[3] for t in batch.column(place)]
            yield batch.filter(pa.array([not t for t in toxic]))

    return docs.mapInArrow(common.lean(keep), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents and scores all documents."""
    docs = common.table(spark, sf_dir, "documents")
    return score(spark, docs, fit(spark, docs, common.table(spark, sf_dir, "labels")))

"""Gradient-boosted decision trees for a few thousand rows, and their form as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: str
    limit: float
    low: Leaf | Split
    high: Leaf | Split


def _grow(x, names, gradient, hessian, rows, depth: int, least: int, damping: float):
    """One tree by exact greedy splits on the second-order gain."""
    import numpy as np

    g, h = gradient[rows].sum(), hessian[rows].sum()
    leaf = Leaf(float(-g / (h + damping)))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        values = x[order, f]
        gs, hs = np.cumsum(gradient[order]), np.cumsum(hessian[order])
        at = np.flatnonzero(values[1:] > values[:-1])
        at = at[(at + 1 >= least) & (len(rows) - at - 1 >= least)]
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + damping) + (g - gs[at]) ** 2 / (h - hs[at] + damping) - g * g / (h + damping)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((values[at[k]] + values[at[k] + 1]) / 2))
    if best[1] is None:
        return leaf
    low = x[rows, best[1]] <= best[2]
    grow = lambda own: _grow(x, names, gradient, hessian, own, depth - 1, least, damping)
    return Split(names[best[1]], best[2], grow(rows[low]), grow(rows[~low]))


def _value(tree, x, names):
    import numpy as np

    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, names.index(tree.feature)] <= tree.limit, _value(tree.low, x, names), _value(tree.high, x, names))


@dataclass(frozen=True)
class Boosted:
    """Sum of trees; a score is on the scale of log-odds."""

    names: tuple[str, ...]
    base: float
    rate: float
    trees: tuple

    @classmethod
    def fit(cls, x, y, names, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8, damping: float = 1.0) -> Boosted:
        import numpy as np

        x, y = np.asarray(x, float), np.asarray(y, float)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        base, trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(x, names, p - y, p * (1 - p), np.arange(len(y)), depth, least, damping)
            trees.append(tree)
            score += rate * _value(tree, x, list(names))
        return cls(tuple(names), base, rate, tuple(trees))

    def scores(self, x):
        import numpy as np

        x = np.asarray(x, float)
        return self.base + self.rate * sum(_value(t, x, list(self.names)) for t in self.trees)

    def column(self, features) -> Column:
        """The score of a struct of features, as nested conditions."""

        def nested(tree) -> Column:
            if isinstance(tree, Leaf):
                return F.lit(self.rate * tree.value)
            return F.when(features[tree.feature] <= tree.limit, nested(tree.low)).otherwise(nested(tree.high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + nested(tree)
        return out

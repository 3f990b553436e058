"""Small boosted trees over binned numeric features, with calibrated scores.

:func:`fit_forest` takes a matrix; :func:`fit_forests` tables of any size, in passes
that add up histograms, with one forest for each kind of row.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tipoff.llm.labelled import fit_logistic, sigmoid
from tipoff.operators.moments import summed_blocks
from tipoff.operators.ordered import running_sums

BINS, DEPTH, ROUNDS, RATE, SHRINK = 16, 3, 60, 0.2, 1.0
CELLS = 50_000  # cells that one task of a pass takes, about; no more are passed over on the driver
RIDGE, STEPS = 1e-2, 50  # of the calibration


@dataclass
class Forest:
    edges: list
    trees: list  # per tree: features and cuts of a full binary tree in heap order, and leaf values
    base: float
    calibration: tuple[float, float] = (0.0, 1.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.raw_of(binned(x, self.edges))

    def raw_of(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for tree in self.trees:
            total += tree[2][_leaf_of(bins, tree[0], tree[1])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return self.score_of(binned(x, self.edges))

    def score_of(self, bins: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return sigmoid(a + b * self.raw_of(bins))


def binned(x: np.ndarray, edges: list) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)


def _leaf_of(bins, features, cuts, depth=DEPTH):
    """Place of every row among the nodes of a level, the leaves by default."""
    node = np.zeros(len(bins), dtype=np.int64)
    for _ in range(depth):
        right = bins[np.arange(len(bins)), features[node]] >= cuts[node]
        node = 2 * node + 1 + right
    return node - (2**depth - 1)


def _histograms(bins, node, width, g, h):
    """Sums of g and h by feature, node of a level and bin."""
    at = node * BINS + bins.T
    return np.array([[np.bincount(a, v, width * BINS).reshape(width, BINS) for a in at] for v in (g, h)])


def _splits(histograms):
    """The split of largest gain for every node of a level, and the sums of g and h to its left and right."""
    width = histograms.shape[2]
    best, nodes = np.zeros(width), np.arange(width)
    features, cuts = np.zeros(width, dtype=np.int64), np.full(width, BINS + 1)
    total = histograms[:, 0].sum(2)
    left = total.copy()
    for k, sums in enumerate(histograms.swapaxes(0, 1)):
        gl, hl = sums.cumsum(2)
        gt, ht = gl[:, -1:], hl[:, -1:]
        gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
        place = gain[:, :-1].argmax(1)
        more = gain[nodes, place]
        better = more > best + 1e-12
        best = np.where(better, more, best)
        features, cuts = np.where(better, k, features), np.where(better, place + 1, cuts)
        left = np.where(better, np.array([gl[nodes, place], hl[nodes, place]]), left)
    return features, cuts, left, total - left


def _grow(histograms_of):
    """One tree: level by level, every node takes the split of largest gain.

    ``histograms_of(features, cuts, level)`` gives the sums at the nodes of a level under the splits above it.
    """
    inner = 2**DEPTH - 1
    features, cuts = np.zeros(inner, dtype=np.int64), np.full(inner, BINS + 1)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        at = slice(first, first + width)
        features[at], cuts[at], left, right = _splits(histograms_of(features, cuts, level))
    return features, cuts, _leaves(left, right)


def _leaves(left, right):
    """Leaf values from the sums to either side of the last level's splits."""
    g, h = np.stack([left, right], axis=2).reshape(2, -1)
    return -RATE * g / (h + SHRINK)


def fit_forest(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Forest | None:
    """Trees fitted on four fifths of the rows and calibrated on the others; None without both labels."""
    if len(y) < 20 or y.min() == y.max():
        return None
    learn = np.arange(len(y)) % 5 != 4
    if y[learn].min() == y[learn].max() or y[~learn].min() == y[~learn].max():
        return None
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for c in x[learn].T]
    rate = y[learn].mean()
    forest = Forest(edges, [], float(np.log(rate / (1 - rate))))
    bins = binned(x[learn], edges)
    total = np.full(learn.sum(), forest.base)
    for _ in range(rounds):
        p = sigmoid(total)
        tree = _grow(lambda f, c, level: _histograms(bins, _leaf_of(bins, f, c, level), 2**level, p - y[learn], p * (1 - p)))
        total += tree[2][_leaf_of(bins, tree[0], tree[1])]
        forest.trees.append(tree)
    a, b = fit_logistic(forest.raw(x[~learn])[:, None], y[~learn], ridge=RIDGE)
    forest.calibration = (float(a), float(b))
    return forest


def edges_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cuts of a feature at quantiles of its values, each of which comes ``counts`` times."""
    order = np.argsort(values)
    ends = np.cumsum(counts[order])
    places = np.rint(np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1))
    return np.unique(values[order][np.searchsorted(ends, places, side="right")])


def _of_fold(batch, held: bool, kinds: int, features: int):
    """(kind, bins, y, n) of a batch's cells of one fold."""
    kind, y, fold, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, features).astype(np.int64)
    for k in range(kinds):
        mine = (kind == k) & (fold == held)
        if mine.any():
            yield k, bins[mine], y[mine].astype(np.float64), n[mine].astype(np.float64)


class _Cells:
    """Passes over written cells: kind, y, held, bins (a byte per feature), n; all rows of one content are one cell."""

    def __init__(self, cells: DataFrame, n: int, kinds: int, features: int):
        parts = -(-n // CELLS) or 1
        self.data, self.meet = cells.select("kind", "y", "held", "bins", "n").coalesce(parts), 4 if parts > 4 else 0
        self.kinds, self.features = kinds, features
        self.few = self.data.toArrow().to_batches() if parts == 1 else None

    def summed(self, held: bool, of, *shape: int) -> np.ndarray:
        """Sums over the cells of a fold: ``of(kind, bins, y, n)`` has ``shape``, or is None."""
        kinds, features = self.kinds, self.features

        def fold(batch):
            total = np.zeros((kinds, *shape))
            for k, *rows in _of_fold(batch, held, kinds, features):
                found = of(k, *rows)
                if found is not None:
                    total[k] += found
            return total.ravel()

        size = int(np.prod((kinds, *shape)))
        if self.few is not None:
            return sum(map(fold, self.few), np.zeros(size)).reshape(kinds, *shape)
        return summed_blocks(self.data, fold, size, meet=self.meet).reshape(kinds, *shape)


def fit_forests(cells: DataFrame, n: int, edges: list, rounds: int = ROUNDS) -> list[Forest | None]:
    """A forest for each kind, as :func:`fit_forest` fits it, from all ``n`` of the written cells.

    Cells have kind, y, held (not learned from, but calibrated on), bins by the
    kind's edges as bytes, and n, how many rows they stand for. One pass per level of the trees
    adds up the histograms of all kinds; the driver sees these alone.
    """
    kinds, features = len(edges), max(map(len, edges))
    table = _Cells(cells, n, kinds, features)
    seen = [table.summed(held, lambda k, bins, y, w: [w.sum(), w @ y], 2) for held in (False, True)]
    forests: list[Forest | None] = [None] * kinds
    for k in range(kinds):
        if seen[0][k, 0] + seen[1][k, 0] >= 20 and all(0 < s[k, 1] < s[k, 0] for s in seen):
            rate = seen[0][k, 1] / seen[0][k, 0]
            forests[k] = Forest(edges[k], [], float(np.log(rate / (1 - rate))))
    known = [k for k in range(kinds) if forests[k]]
    for _ in range(rounds if known else 0):
        inner = 2**DEPTH - 1
        grown = {k: (np.zeros(inner, dtype=np.int64), np.full(inner, BINS + 1)) for k in known}
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level

            def sums(k, bins, y, w):
                if k in grown:
                    p = sigmoid(forests[k].raw_of(bins))
                    return _histograms(bins, _leaf_of(bins, *grown[k], level), width, w * (p - y), w * p * (1 - p))

            found = table.summed(False, sums, 2, features, width, BINS)
            for k in known:
                grown[k][0][first:first + width], grown[k][1][first:first + width], left, right = _splits(found[k])
                if level == DEPTH - 1:
                    forests[k].trees.append((*grown[k], _leaves(left, right)))
    _calibrate(table, forests, known)
    return forests


def _calibrate(table: _Cells, forests: list, known: list[int]) -> None:
    """Logistic intercept and slope of each forest's raw scores on the held cells, by Newton steps as in fit_logistic."""
    weights, penalty, open_ = {k: np.zeros(2) for k in known}, np.array([1e-3, RIDGE]), set(known)
    for _ in range(STEPS):
        if not open_:
            break

        def sums(k, bins, y, w):
            if k in open_:
                x = np.column_stack([np.ones(len(y)), forests[k].raw_of(bins)])
                p = sigmoid(x @ weights[k])
                return np.vstack([x.T @ (w * (p - y)), (x * (w * (p * (1 - p) + 1e-9))[:, None]).T @ x])

        found = table.summed(True, sums, 3, 2)
        for k in list(open_):
            step = np.linalg.solve(found[k][1:] + np.diag(penalty), found[k][0] + penalty * weights[k])
            weights[k] = weights[k] - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                open_.discard(k)
    for k in known:
        forests[k].calibration = tuple(map(float, weights[k]))


def thresholds(cells: DataFrame, n: int, forests: list, percent: int) -> dict[int, float]:
    """Per kind the lowest score down to which at least ``percent`` hundredths of the held rows are 1; kinds without one are left out."""
    kinds, features = len(forests), max((len(f.edges) for f in forests if f), default=0)

    def score(batches):
        for batch in batches:
            for k, bins, y, w in _of_fold(batch, True, kinds, features):
                if forests[k]:
                    columns = [np.full(len(y), k), forests[k].score_of(bins), (w * (100 * y - percent)).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "score", "over"])

    if not features:
        return {}
    scored = cells.select("kind", "y", "held", "bins", "n").mapInArrow(score, "kind long, score double, over long").groupBy("kind", "score").agg(F.sum("over").alias("over"))
    summed = running_sums(scored, ["kind"], [F.desc("score")], "over", {"total": []}, row_bound=n)
    return {r.kind: r.least for r in summed.where("total >= 0").groupBy("kind").agg(F.min("score").alias("least")).collect()}

"""Least-squares policy iteration for the right to stop early."""

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tipoff.functions.payoff import linear_score
from tipoff.operators import exact
from tipoff.operators.moments import vectors
from tipoff.operators.pairs import add_payoff, bellman_pairs
from tipoff.schema import STATE
from tipoff.session import discard, materialize


@dataclass(frozen=True)
class Policy:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    iterations: int


def _batch_pair(batch, width):
    phi, following = vectors(batch.column(0), width), vectors(batch.column(1), width)
    payoff = batch.column(2).to_numpy(zero_copy_only=False)
    alive = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
    return phi, following, payoff, alive


class _System:
    """The linear systems of the iterations over one written table of pairs, to the last bit the same however its rows are dealt out."""

    def __init__(self, data: DataFrame, width: int, gamma: float):
        self.data, self.width, self.gamma = data, width, gamma
        columns = [F.col(c)[i] for c in ("Phi", "PhiNext") for i in range(width)] + [F.col("Payoff")]
        sizes = exact.bounds(data, columns)
        phi, following, payoff = sizes[:width], sizes[width:-1], sizes[-1]
        self.left = np.concatenate([phi, [1.0]])
        step = [exact.power_above(a + abs(gamma) * b) for a, b in zip(phi, following)]
        self.right = np.array([*step, exact.power_above(abs(gamma) * payoff), 1.0])

    def sums(self, weights: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Sum of phi (phi - hold*gamma*next)', of gamma*stop*payoff*phi (both in fractions), and how many holds changed."""
        width, gamma = self.width, self.gamma

        def fold(batch):
            phi, following, payoff, alive = _batch_pair(batch, width)
            hold = alive & (exact.row_products(following, weights) > payoff)
            was_hold = alive & (exact.row_products(following, previous) > payoff)
            step = phi - gamma * following * hold[:, None]
            left = np.column_stack([phi, np.ones(len(phi))])
            return left, np.column_stack([step, gamma * payoff * ~hold, hold ^ was_hold])

        found = exact.summed_products(self.data, fold, self.left, self.right)
        return found[:width, :width], found[:width, width], int(found[width, width + 1])


def _ridge(eps: float, width: int) -> np.ndarray:
    return np.array([[Fraction(eps) if i == j else Fraction(0) for j in range(width)] for i in range(width)])


def _inputs(pairs):
    return pairs.select("Phi", "PhiNext", F.col("Payoff").cast("double").alias("Payoff"), "Alive")


def bellman_gram(
    pairs: DataFrame, weights: list[float] | None = None,
    *, gamma: float = 1.0, eps: float = 1e-3, width: int = len(STATE),
) -> DataFrame:
    """The linear system of one iteration as (i, j, value); j = width is the right-hand side. Jobs run when this is called."""
    w = np.zeros(width) if weights is None else np.asarray(weights, dtype=float)
    data = materialize(_inputs(pairs))
    matrix, target, _ = _System(data, width, gamma).sums(w, w)
    discard(data)
    cells = np.column_stack([matrix + _ridge(eps, width), target])
    rows = [(i, j, float(cells[i, j])) for i in range(width) for j in range(width + 1)]
    return pairs.sparkSession.createDataFrame(rows, "i int, j int, value double")


def lspi_fit(
    pairs: DataFrame, *, features: list[str] = STATE, iters: int = 100,
    eps: float = 1e-3, gamma: float = 1.0,
) -> Policy:
    """Fit the continuation value. One job per iteration over the written pairs.

    When no hold decision changes, later iterations repeat the same system, so
    stopping there gives exactly the result of running all ``iters``. Sums and
    the solution of the small system are fractions, rounded once: weights do not
    depend on how rows are dealt out, and keep their digits where features are
    collinear and only the ridge tells their weights apart.
    """
    width = len(features)
    data = materialize(_inputs(pairs))
    system = _System(data, width, gamma)
    weights, previous = np.zeros(width), np.zeros(width)
    done = 0
    for done in range(1, iters + 1):
        matrix, target, changed = system.sums(weights, previous)
        if done > 1 and not changed:
            break
        previous, weights = weights, exact.solve(matrix + _ridge(eps, width), target)
    discard(data)
    return Policy(tuple(features), tuple(float(w) for w in weights), done)


def prepare_pairs(rows: DataFrame, intervals: int = 4) -> DataFrame:
    """Rows with payoff and both state vectors; the vectors are kept where the rows have them."""
    return add_payoff(rows if "PhiNext" in rows.columns else bellman_pairs(rows), intervals)


def weights_table(spark: SparkSession, policy: Policy) -> DataFrame:
    rows = list(zip(range(len(policy.weights)), policy.features, policy.weights, strict=True))
    return spark.createDataFrame(rows, "position int, feature string, weight double")


def score_linear(rows: DataFrame, policy: Policy, out: str = "res") -> DataFrame:
    return rows.withColumn(out, linear_score([F.col(c) for c in policy.features], policy.weights))


def exercise_policy(pairs: DataFrame, policy: Policy) -> DataFrame:
    """Value of going on (score of the next state) and the decision."""
    following = [F.col("PhiNext")[i] for i in range(len(policy.features))]
    return pairs.withColumn("Continuation", linear_score(following, policy.weights)).withColumn(
        "Decision",
        F.when(F.col("Alive") & (F.col("Continuation") > F.col("Payoff")), "hold").otherwise("exercise"),
    )

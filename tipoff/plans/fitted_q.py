"""Fitted-Q training of the network, and scoring with it.

Training takes full-table steps: each task sums the gradient of its rows (466
numbers), or its normal equations, Spark adds the sums, the driver moves the
parameters. :func:`fit_to_convergence` stops when the loss has settled;
:func:`fitted_q` takes a given number of plain steps.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tipoff.functions import network
from tipoff.operators.moments import summed_blocks, summed_vector, vectors
from tipoff.operators.scaling import Scaling, z_scores
from tipoff.schema import STATE
from tipoff.session import discard, materialize
from tipoff.sources.model_store import Model, Progress

STALLED = 1e9  # damping beyond which no step is worth trying


@dataclass(frozen=True)
class QFit:
    theta: np.ndarray
    losses: tuple[float, ...]
    rates: tuple[float, ...]
    converged: bool = False
    stalled: bool = False


def _targets(theta, following, payoff, alive):
    return np.where(alive, np.maximum(payoff, network.forward(theta, following)), payoff)


def _batch(batch, width):
    phi, following = vectors(batch.column(0), width), vectors(batch.column(1), width)
    payoff = batch.column(2).to_numpy(zero_copy_only=False)
    return phi, following, payoff, batch.column(3).to_numpy(zero_copy_only=False).astype(bool)


def _loss_fold(theta, width):
    """Per batch: the squared error and the rows."""
    def fold(batch):
        phi, following, payoff, alive = _batch(batch, width)
        miss = _targets(theta, following, payoff, alive) - network.forward(theta, phi)
        return np.array([miss @ miss, len(phi)])

    return fold, 2


def _normal_fold(theta, width, rows=2048):
    """Per batch: J'J, J'(target - q) and the rows."""
    size = len(theta)

    def fold(batch):
        phi, following, payoff, alive = _batch(batch, width)
        target = _targets(theta, following, payoff, alive)
        square, slope = np.zeros((size, size)), np.zeros(size)
        for at in range(0, len(phi), rows):
            q, slopes = network.jacobian(theta, phi[at:at + rows])
            square += slopes.T @ slopes
            slope += slopes.T @ (target[at:at + rows] - q)
        return np.concatenate([square.ravel(), slope, [len(phi)]])

    return fold, size * size + size + 1


def fit_to_convergence(
    pairs: DataFrame, *, tolerance: float = 1e-4, settled: int = 5, ceiling: int = 300,
    ridge: float = 1e-6, seed: int = 100, width: int = len(STATE), progress: str | None = None,
) -> QFit:
    """Damped Gauss-Newton steps over the full table until the loss settles.

    A step that lowers the loss (against targets of its own parameters) is
    taken and the damping eased; otherwise the damping grows. ``converged``
    means that ``settled`` steps in a row lowered the loss by less than
    ``tolerance`` of itself; ``stalled`` that no damping finds a lower loss,
    which need not be the end of the way; neither that ``ceiling`` evaluations
    were not enough. An evaluation passes over the table for its loss alone; only
    a step that is taken needs the normal equations, a second and far dearer pass.

    With ``progress``, a folder of its own, every evaluation is written there,
    and a call finds it and goes on from the last one: training survives the
    loss of the driver. Such a folder belongs to one training table.
    """
    data = materialize(pairs.select("Phi", "PhiNext", "Payoff", "Alive"))
    kept = Progress(pairs.sparkSession, progress)
    theta = network.initial_parameters(width, seed)
    size = len(theta)

    def loss_at(at):
        error, rows = summed_blocks(data, *_loss_fold(at, width), meet=0)
        return float(error / max(rows, 1.0))

    def normal_at(at):
        sums = summed_blocks(data, *_normal_fold(at, width))
        rows = max(sums[-1], 1.0)
        return sums[:size * size].reshape(size, size) / rows, sums[size * size:-1] / rows

    before = kept.last()
    if before is not None:
        theta = np.array(before["theta"])
    loss = loss_at(theta)
    normal = None
    losses, damping, quiet = [loss], 1e-2, 0
    if before is not None:
        losses, (damping, quiet) = before["losses"], before["state"]
    while len(losses) < ceiling and quiet < settled and damping <= STALLED:
        square, slope = normal = normal or normal_at(theta)
        lift = np.diag(damping * (np.diag(square) + 1e-3) + ridge)
        candidate = theta + np.linalg.solve(square + lift, slope)
        trial = loss_at(candidate)
        losses.append(min(loss, trial))
        if trial < loss:
            quiet = quiet + 1 if loss - trial < tolerance * loss else 0
            theta, loss, normal = candidate, trial, None
            damping = max(damping / 3, 1e-9)
        else:
            damping *= 4
        kept.save(len(losses), {"theta": theta, "losses": losses, "state": [damping, quiet]})
    discard(data)
    return QFit(theta, tuple(losses), (), quiet >= settled, quiet < settled and damping > STALLED)


def _step_fold(theta, width):
    def fold(batch):
        phi, following, payoff, alive = _batch(batch, width)
        target = _targets(theta, following, payoff, alive)
        q, gradient = network.weighted_gradient(theta, phi, lambda q: target - q)
        return np.concatenate([gradient, [np.square(target - q).sum(), len(q)]])

    return fold, len(theta) + 2


def fitted_q(
    pairs: DataFrame, *, steps: int = 200, rate: float = 0.003, decay: float = 0.999,
    floor: float = 1e-5, seed: int = 100, width: int = len(STATE),
) -> QFit:
    """Plain steps towards max(payoff, value of the next state); at the last interval, the payoff.

    Takes exactly ``steps`` steps and says nothing on convergence.
    """
    data = materialize(pairs.select("Phi", "PhiNext", "Payoff", "Alive"))
    theta = network.initial_parameters(width, seed)
    losses, rates = [], []
    for _ in range(steps):
        fold, size = _step_fold(theta, width)
        sums = summed_vector(data, fold, size)
        rows = max(sums[-1], 1.0)
        losses.append(float(sums[-2] / rows))
        rates.append(rate)
        theta = theta + rate * sums[:-2] / rows
        rate = max(rate * decay, floor)
    discard(data)
    return QFit(theta, tuple(losses), tuple(rates))


def loss_table(spark: SparkSession, fit: QFit) -> DataFrame:
    rows = [(i, loss, rate) for i, (loss, rate) in enumerate(zip(fit.losses, fit.rates, strict=True))]
    return spark.createDataFrame(rows, "step int, loss double, rate double")


def score_network(
    rows: DataFrame, theta: np.ndarray, out: str = "res",
    *, scaling: Scaling | None = None, state: list[str] = STATE,
) -> DataFrame:
    """Network value of each row, an Arrow batch at a time; the row's own columns stay unscaled.

    A row with a missing state has no value.
    """
    columns = {c: F.col(c) for c in state} if scaling is None else z_scores(scaling)
    inputs = F.array(*[F.coalesce(columns[c].cast("double"), F.lit(float("nan"))) for c in state])
    width = len(state)

    def value(batches):
        for batch in batches:
            found = network.forward(theta, vectors(batch.column(batch.num_columns - 1), width))
            values = pa.array(found, mask=np.isnan(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*batch.schema.names[:-1], out])

    kept = rows.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    return kept.withColumn("_phi", inputs).mapInArrow(value, schema)


def price_scenarios(
    scenarios: DataFrame, scaling: Scaling, theta: np.ndarray, out: str = "price"
) -> DataFrame:
    """Value hypothetical states with the statistics and network of the training table."""
    return score_network(scenarios, theta, out, scaling=scaling)


def score_model(rows: DataFrame, model: Model, out: str = "res") -> DataFrame:
    """Network value of each row by a stored model, with the statistics it was trained with."""
    return score_network(rows, model.theta, out, scaling=model.scaling)

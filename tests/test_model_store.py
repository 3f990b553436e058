"""Stored networks, training that goes on where it stopped, and scores of a converged network against a small dense run."""

import numpy as np
import pytest

from tests.test_valuation import synthetic
from tipoff.functions import network
from tipoff.operators import pairs as pair_ops, scaling
from tipoff.plans import fitted_q, lspi
from tipoff.schema import STATE
from tipoff.session import new_path
from tipoff.sources import model_store


@pytest.fixture(scope="module")
def rows(spark):
    schema = "Player string, GameId long, " + ", ".join(f"{c} double" for c in STATE)
    return spark.createDataFrame(synthetic(episodes=15), schema).repartition(3)


def dense(phi, following, payoff, alive, seed, ceiling, tolerance=1e-4, settled=5):
    """Damped Gauss-Newton over one matrix, with derivatives by differences."""
    theta = network.initial_parameters(phi.shape[1], seed)

    def miss(at):
        target = np.where(alive, np.maximum(payoff, network.forward(at, following)), payoff)
        return target - network.forward(at, phi)

    def slopes(at):
        step, out = 1e-5, np.empty((len(phi), len(at)))
        for i in range(len(at)):
            move = np.zeros(len(at))
            move[i] = step
            out[:, i] = (network.forward(at + move, phi) - network.forward(at - move, phi)) / (2 * step)
        return out

    m, j, damping, quiet, n = miss(theta), slopes(theta), 1e-2, 0, 1
    loss = (m @ m) / len(phi)
    while n < ceiling and quiet < settled:
        square = j.T @ j / len(phi)
        trial = theta + np.linalg.solve(square + np.diag(damping * (np.diag(square) + 1e-3) + 1e-6), j.T @ m / len(phi))
        t = miss(trial)
        n += 1
        if (t @ t) / len(phi) < loss:
            new = (t @ t) / len(phi)
            quiet = quiet + 1 if loss - new < tolerance * loss else 0
            theta, m, j, loss, damping = trial, t, slopes(trial), new, max(damping / 3, 1e-9)
        else:
            damping *= 4
    return theta, loss


def prepared(rows):
    stats = scaling.fit_scaling(rows)
    return stats, lspi.prepare_pairs(scaling.standardize(rows, stats), 4)


def test_training_goes_on_after_a_lost_driver(spark, rows):
    _, pairs = prepared(rows)
    path = new_path(spark)
    whole = fitted_q.fit_to_convergence(pairs, ceiling=9)
    first = fitted_q.fit_to_convergence(pairs, ceiling=4, progress=path)
    assert len(first.losses) == 4 and not first.converged and not first.stalled
    # A half-written evaluation has no success mark and is passed over.
    spark.createDataFrame([("theta", 0, None, 1.0)], model_store.SCHEMA).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/step=99")
    rest = fitted_q.fit_to_convergence(pairs, ceiling=9, progress=path)
    assert len(rest.losses) == 9
    assert np.allclose(rest.losses, whole.losses, rtol=1e-6)
    assert np.allclose(rest.theta, whole.theta, rtol=1e-4, atol=1e-6)
    done = fitted_q.fit_to_convergence(pairs, ceiling=9, progress=path)
    assert np.array_equal(done.theta, rest.theta)


def test_a_stall_is_not_convergence(spark, rows, monkeypatch):
    _, pairs = prepared(rows)
    monkeypatch.setattr(fitted_q, "STALLED", 0.0)
    fit = fitted_q.fit_to_convergence(pairs)
    assert fit.stalled and not fit.converged


def test_only_steps_that_are_taken_need_normal_equations(spark, rows, monkeypatch):
    _, pairs = prepared(rows)
    dear, real = [], fitted_q._normal_fold
    monkeypatch.setattr(fitted_q, "_normal_fold", lambda theta, width: dear.append(theta) or real(theta, width))
    fit = fitted_q.fit_to_convergence(pairs, ceiling=12)
    taken = sum(b < a for a, b in zip(fit.losses, fit.losses[1:]))
    monkeypatch.setattr(fitted_q, "STALLED", 1e6)
    monkeypatch.setattr(fitted_q.np.linalg, "solve", lambda a, b: np.full(len(b), 1e3))  # no step helps
    rejected = len(dear)
    stuck = fitted_q.fit_to_convergence(pairs, ceiling=9)
    assert rejected <= taken + 1 and all((a != b).any() for a, b in zip(dear, dear[1:rejected]))
    assert len(stuck.losses) == 9 and len(set(stuck.losses)) == 1 and len(dear) == rejected + 1


def test_versions(spark, rows):
    stats, _ = prepared(rows)
    path = new_path(spark)
    with pytest.raises(ValueError):
        model_store.load_model(spark, path)
    one, two = network.initial_parameters(13, 1), network.initial_parameters(13, 2)
    assert model_store.save_model(spark, path, one, stats, {"loss": 0.5}) == 1
    assert model_store.save_model(spark, path, two, stats) == 2
    newest, first = model_store.load_model(spark, path), model_store.load_model(spark, path, 1)
    assert np.array_equal(newest.theta, two) and newest.version == 2 and newest.facts == {}
    assert np.array_equal(first.theta, one) and first.facts == {"loss": 0.5}
    assert first.scaling == stats
    with pytest.raises(ValueError):
        model_store.load_model(spark, path, 3)
    assert model_store.model_table(spark, path, 1).count() == 466 + 2 * 13 + 1


def test_stored_network_prices_like_a_dense_run(spark, rows):
    stats, pairs = prepared(rows)
    found = pairs.select("Phi", "PhiNext", "Payoff", "Alive").collect()
    phi, following = (np.array([r[c] for r in found]) for c in ("Phi", "PhiNext"))
    payoff, alive = np.array([r.Payoff for r in found], dtype=float), np.array([r.Alive for r in found])
    fit = fitted_q.fit_to_convergence(pairs, ceiling=25, seed=100)
    theta, loss = dense(phi, following, payoff, alive, 100, 25)
    assert abs(fit.losses[-1] - loss) <= 0.02 * loss
    path = new_path(spark)
    model_store.save_model(spark, path, fit.theta, stats)
    scored = fitted_q.score_model(rows, model_store.load_model(spark, path), "price")
    inputs = np.array([[getattr(r, c) for c in STATE] for r in scored.collect()])
    scaled = np.column_stack([
        (inputs[:, i] - stats.means[c]) / stats.deviations[c] if stats.deviations[c] else np.zeros(len(inputs)) for i, c in enumerate(STATE)
    ])
    got = np.array([r.price for r in scored.collect()], dtype=float)
    want = network.forward(theta, scaled)
    spread = want.max() - want.min()
    assert np.abs(got - want).mean() <= 0.03 * spread

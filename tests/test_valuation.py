import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipoff.functions import network, payoff
from tipoff.operators import moments, pairs, scaling
from tipoff.plans import fitted_q, lspi
from tipoff.schema import PAYOFF_COLUMNS, STATE
from tipoff.sources import play_log

WIDTH = len(STATE)
POINTS, AVERAGE = STATE.index(PAYOFF_COLUMNS[1]), STATE.index(PAYOFF_COLUMNS[2])


def synthetic(seed=0, episodes=40, n=4):
    """State rows (player, game, 13 features), n + 1 per episode."""
    rng = np.random.default_rng(seed)
    out = []
    for e in range(episodes):
        average, own, other, score = rng.uniform(10, 30), 0, 0, 0
        home, rest = float(rng.integers(2)), rng.integers(0, 5, 2)
        for i in range(n + 1):
            if i:
                score, own, other = score + rng.poisson(5), own + rng.poisson(25), other + rng.poisson(25)
            margin, left = own - other, 48 - 12 * i
            out.append((f"p{e % 7}", e, float(i), float(score), home, float(rest[0]), float(rest[1]), float(own),
                        float(other), float(margin), float(abs(margin) * left), float(abs(margin) * left**2),
                        average, 105.0 + e % 9, 110.0 - e % 5))
    return out


@pytest.fixture(scope="module")
def state_rows(spark):
    schema = "Player string, GameId long, " + ", ".join(f"{c} double" for c in STATE)
    return spark.createDataFrame(synthetic(), schema).repartition(3)


@pytest.fixture(scope="module")
def matrices():
    data = synthetic()
    phi = np.array([r[2:] for r in data])
    following = np.vstack([phi[1:], np.zeros(WIDTH)])
    ends = phi[:, 0] == 4
    following[ends] = 0
    gain = np.maximum(phi[:, POINTS] - phi[:, AVERAGE] * phi[:, 0] / 4, 0)
    return phi, following, gain, ~ends


def test_golden_payoffs(spark):
    data = [(18.0, i, p) for i, p in enumerate([0, 5, 14, 20, 20])]
    got = pairs.expected_path(
        spark.createDataFrame(data, "avg double, i int, pts int"), points="pts", average="avg", interval="i"
    ).orderBy("i").collect()
    assert [r.ExpectedPoints for r in got] == [0, 4.5, 9, 13.5, 18]
    assert [r.PathPayoff for r in got] == [0, 0.5, 5, 6.5, 2]
    states = [(30.0, 1, 15), (30.0, 2, 20), (30.0, 3, 23), (20.0, 1, 33), (20.0, 2, 33), (20.0, 3, 38), (20.0, 4, 0)]
    valued = pairs.add_payoff(
        spark.createDataFrame(states, "avg double, i int, pts int"), points="pts", average="avg", interval="i"
    ).collect()
    assert [r.Payoff for r in valued] == [7.5, 5, 0.5, 28, 23, 23, 0]
    assert [r.Alive for r in valued] == [True] * 6 + [False]


def test_training_rows_need_form_and_all_features(spark):
    schema = ", ".join(f"{c} double" for c in STATE)
    full = [20.0] * WIDTH
    gap = [20.0] * WIDTH
    gap[3] = None
    nan = [20.0] * WIDTH
    nan[4] = math.nan
    low = [15.0] * WIDTH
    frame = spark.createDataFrame([full, gap, nan, low], schema)
    assert pairs.training_rows(frame).collect() == [tuple(full)]


def test_pairs_follow_their_episode(state_rows, matrices):
    phi, following, gain, alive = matrices
    got = lspi.prepare_pairs(state_rows).orderBy("GameId", "Interval").collect()
    np.testing.assert_array_equal([r.Phi for r in got], phi)
    np.testing.assert_array_equal([r.PhiNext for r in got], following)
    np.testing.assert_allclose([r.Payoff for r in got], gain)
    assert [r.Alive for r in got] == list(alive)


def direct(matrices, iters, eps=1e-3, gamma=1.0):
    phi, following, gain, alive = matrices
    w = np.zeros(WIDTH)
    for _ in range(iters):
        hold = alive & (following @ w > gain)
        a = eps * np.eye(WIDTH) + phi.T @ (phi - gamma * following * hold[:, None])
        w = np.linalg.lstsq(a, phi.T @ (gamma * gain * ~hold), rcond=None)[0]
    return w


@pytest.mark.parametrize("gamma", [1.0, 0.9])
def test_early_stop_equals_all_iterations(state_rows, matrices, gamma):
    fit = lspi.lspi_fit(lspi.prepare_pairs(state_rows), gamma=gamma)
    assert fit.iterations < 100
    np.testing.assert_allclose(
        matrices[0] @ np.array(fit.weights), matrices[0] @ direct(matrices, 100, gamma=gamma), rtol=1e-5, atol=1e-6
    )


def test_gram_of_a_given_policy(state_rows, matrices):
    phi, following, gain, alive = matrices
    w = np.linspace(-0.01, 0.02, WIDTH)
    hold = alive & (following @ w > gain)
    assert hold.any() and not hold.all()
    want = np.column_stack([
        phi.T @ (phi - 0.5 * following * hold[:, None]) + 1e-3 * np.eye(WIDTH), phi.T @ (0.5 * gain * ~hold)
    ])
    got = np.full(want.shape, np.nan)
    for r in lspi.bellman_gram(lspi.prepare_pairs(state_rows), list(w), gamma=0.5).collect():
        got[r.i, r.j] = r.value
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_scores_keep_their_keys_and_decide(state_rows):
    valued = lspi.prepare_pairs(state_rows)
    fit = lspi.lspi_fit(valued)
    w = np.array(fit.weights)
    for r in lspi.exercise_policy(lspi.score_linear(valued, fit), fit).collect():
        assert r.res == pytest.approx(np.dot(r.Phi, w), abs=1e-9)
        cont = np.dot(r.PhiNext, w)
        assert r.Decision == ("hold" if r.Alive and cont > r.Payoff else "exercise")


def test_scored_rows_are_written_with_their_keys(spark, state_rows, tmp_path):
    fit = lspi.Policy(tuple(STATE), tuple(0.1 for _ in STATE), 1)
    scored = lspi.score_linear(state_rows, fit)
    play_log.write_scores(scored, str(tmp_path / "out"))
    back = play_log.read_table(spark, str(tmp_path / "out"), scored.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scored.collect()))


def test_gram_matrix_of_two_arrays(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 2))
    frame = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<float>, y array<double>")
    got = {(r.i, r.j): r.value for r in moments.gram_matrix(frame.repartition(9), "x", "y", (3, 2)).collect()}
    want = x.astype(np.float32).astype(float).T @ y
    assert len(got) == 6
    for (i, j), value in got.items():
        assert value == pytest.approx(want[i, j], rel=1e-12)


def test_scaling_and_constant_columns(state_rows, matrices):
    phi = matrices[0]
    stats = scaling.fit_scaling(state_rows)
    for i, c in enumerate(STATE):
        untouched = c in PAYOFF_COLUMNS
        assert stats.means[c] == pytest.approx(0 if untouched else phi[:, i].mean())
        assert stats.deviations[c] == pytest.approx(1 if untouched else phi[:, i].std())
    flat = state_rows.withColumn("Home", F.lit(1.0))
    assert scaling.standardize(flat, scaling.fit_scaling(flat)).where("Home IS NOT NULL").count() == 0


def test_histogram_counts_every_row(spark):
    values = np.concatenate([np.random.default_rng(1).normal(size=500), [5.0, 5.0]])
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = scaling.score_histogram(frame, "v").orderBy("bin").collect()
    want, edges = np.histogram(values, bins=100)
    assert [r.rows for r in got] == want.tolist()
    np.testing.assert_allclose([r.left_edge for r in got], edges[:-1])
    same = scaling.score_histogram(frame.where("v = 5"), "v").where("rows > 0").collect()
    assert [(r.bin, r.rows) for r in same] == [(50, 2)]


def test_network_shape_and_gradient():
    theta = network.initial_parameters(WIDTH, 1)
    assert len(theta) == network.parameter_count(WIDTH) == 466
    x = np.random.default_rng(0).normal(size=(6, WIDTH))
    error = np.linspace(-1, 1, 6)
    q, gradient = network.weighted_gradient(theta, x, lambda q: error)
    np.testing.assert_allclose(q, network.forward(theta, x))
    for at in (0, 100, 195, 209, 300, 440, 450, 465):
        bump = np.zeros(466)
        bump[at] = 1e-6
        slope = (error @ network.forward(theta + bump, x) - error @ network.forward(theta - bump, x)) / 2e-6
        assert gradient[at] == pytest.approx(slope, rel=1e-4, abs=1e-8)


def test_training_lowers_the_loss_and_decays_the_rate(state_rows, matrices):
    scaled = scaling.standardize(state_rows, scaling.fit_scaling(state_rows))
    fit = fitted_q.fitted_q(lspi.prepare_pairs(scaled), steps=15, rate=0.05, decay=0.5, floor=0.02)
    assert fit.losses[-1] < 0.8 * fit.losses[0]
    assert fit.rates[:4] == (0.05, 0.025, 0.02, 0.02)


def test_network_scores_rows_and_scenarios(spark, state_rows, matrices):
    phi = matrices[0]
    theta = network.initial_parameters(WIDTH, 5)
    stats = scaling.fit_scaling(state_rows)
    z = (phi - [stats.means[c] for c in STATE]) / [stats.deviations[c] for c in STATE]
    want = network.forward(theta, z)
    got = fitted_q.score_network(state_rows, theta, scaling=stats).orderBy("GameId", "Interval").collect()
    np.testing.assert_allclose([r.res for r in got], want, rtol=1e-10)
    assert got[1].CumulativePlayerPointsInterval == phi[1][1]
    asked = spark.createDataFrame([("a", *map(float, phi[7]))], "name string, " + ", ".join(f"{c} double" for c in STATE))
    price = fitted_q.price_scenarios(asked, stats, theta).first()
    assert (price.name, price.price) == ("a", pytest.approx(want[7]))


def test_option_columns(spark):
    frame = spark.createDataFrame([(0.0, 50.0), (0.25, 100.0), (1.0, 150.0)], "t double, s double")
    basis = payoff.option_basis(F.col("t"), F.col("s"), strike=100.0, expiry=1.0)
    got = frame.select(*basis).collect()
    for (t, s), r in zip([(0.0, 50.0), (0.25, 100.0), (1.0, 150.0)], got):
        x = s / 100
        want = [1, math.exp(-x / 2), math.exp(-x / 2) * (1 - x), math.cos(t * math.pi / 2), math.log(1 - t) if t < 1 else 0, t * t]
        assert list(r) == pytest.approx(want, abs=1e-12)
    steps = spark.createDataFrame([(0, 90.0, 15.0), (0, 80.0, 15.0), (9, 90.0, 15.0), (9, 120.0, 1.0)], "k int, s double, c double")
    target = payoff.put_target(F.col("s"), F.col("k"), F.col("c"), strike=100.0, rate=0.1, expiry=1.0, steps=10)
    g = math.exp(-0.01)
    assert [r[0] for r in steps.select(target).collect()] == pytest.approx([15 * g, 20 * g, 10 * g, 0])

"""Sums that do not depend on partitions, against fractions."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipoff.operators import exact
from tipoff.operators.moments import vectors
from tipoff.plans import lspi


def matrix(seed, rows=700, columns=4):
    rng = random.Random(seed)
    return np.array([[rng.choice([0.1, -1e6, 3e-4, 7.0, 1e9]) * rng.random() for _ in range(columns)] for _ in range(rows)])


def test_slices_add_up_to_the_number():
    values = matrix(1)
    bound = np.array([exact.power_above(np.abs(c).max()) for c in values.T])
    back = sum(s / 2.0 ** (exact.SLICE * (k + 1)) for k, s in enumerate(exact.sliced(values, bound))) * bound
    assert np.abs(back - values).max() <= bound.max() * 2.0 ** -(exact.SLICE * exact.SLICES)
    assert exact.power_above(1.0) == 2.0 and exact.power_above(0.0) == 1.0 and exact.power_above(0.75) == 1.0
    with pytest.raises(ValueError):
        exact.power_above(float("nan"))


def test_sums_are_the_same_to_the_last_bit_for_every_partitioning(spark):
    values = matrix(2)
    frame = spark.createDataFrame([(v.tolist(),) for v in values], "x array<double>")
    bound = exact.bounds(frame, [F.col("x")[i] for i in range(4)])
    fold = lambda batch: (vectors(batch.column(0), 4), vectors(batch.column(0), 4)[:, :2])
    found = [
        tuple(exact.summed_products(f, fold, bound, bound[:2]).ravel())
        for f in (frame.repartition(1), frame.repartition(13), frame.orderBy(F.rand(4)).repartition(5), frame.coalesce(2))
    ]
    assert len(set(found)) == 1
    got = np.array(found[0]).reshape(4, 2)
    for i in range(4):
        for j in range(2):
            want = sum(Fraction(a) * Fraction(b) for a, b in zip(values[:, i].tolist(), values[:, j].tolist()))
            assert abs(got[i, j] - want) <= 1e-18 * bound[i] * bound[j]
    empty = frame.where("false")
    assert not exact.summed_products(empty, fold, bound, bound[:2]).any()
    with pytest.raises(Exception, match="exceeds its bound"):
        exact.summed_products(frame, fold, bound / 4, bound[:2])


def test_small_systems_are_solved_in_fractions():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(6, 6))
    x = rng.normal(size=6)
    assert np.allclose(exact.solve(a, a @ x), x, rtol=1e-9)
    nearly = np.array([[1.0, 1.0], [1.0, 1.0 + 2.0**-52]])
    assert exact.solve(nearly, np.array([2.0, 2.0 + 2.0**-51])).tolist() == [0.0, 2.0]
    with pytest.raises(np.linalg.LinAlgError):
        exact.solve(np.ones((2, 2)), np.ones(2))


def pairs(spark, seed=5, rows=300, width=3):
    rng = random.Random(seed)
    made = []
    for _ in range(rows):
        a, b = ([rng.choice([1.0, 30.0, 1e4]) * rng.random() for _ in range(width)] for _ in range(2))
        made.append(([*a, a[0] - a[1]], [*b, b[0] - b[1]], rng.random() * 20, rng.random() < 0.8))
    return made, spark.createDataFrame(made, "Phi array<double>, PhiNext array<double>, Payoff double, Alive boolean")


def slow_fit(made, gamma, eps):
    """Policy iteration in fractions throughout."""
    width, w, seen = 4, [Fraction(0)] * 4, None
    for _ in range(100):
        holds = tuple(alive and sum(Fraction(x) * v for x, v in zip(b, w)) > payoff for _, b, payoff, alive in made)
        if holds == seen:
            break
        seen = holds
        a = [[Fraction(float(eps)) * (i == j) for j in range(width)] for i in range(width)]
        t = [Fraction(0)] * width
        for (phi, following, payoff, _), hold in zip(made, holds):
            step = [Fraction(p - (gamma * f if hold else 0.0)) for p, f in zip(phi, following)]
            for i in range(width):
                t[i] += 0 if hold else Fraction(gamma * payoff) * Fraction(phi[i])
                for j in range(width):
                    a[i][j] += Fraction(phi[i]) * step[j]
        w = [Fraction(x) for x in exact.solve(np.array(a, dtype=object), np.array(t, dtype=object)).tolist()]
    return [float(x) for x in w]


def test_weights_agree_to_eight_digits_and_in_every_partitioning(spark):
    made, frame = pairs(spark)
    features = ["a", "b", "c", "d"]
    fits = [lspi.lspi_fit(f, features=features, gamma=0.9) for f in (frame.repartition(1), frame.repartition(3), frame.repartition(11))]
    assert len({f.weights for f in fits}) == 1 and len({f.iterations for f in fits}) == 1
    # The fourth feature is the first less the second: only the ridge pins their weights.
    assert np.allclose(fits[0].weights, slow_fit(made, 0.9, 1e-3), rtol=1e-8, atol=0)

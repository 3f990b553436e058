"""Payoffs, scores and option basis functions as column expressions."""

import math

from pyspark.sql import Column, functions as F


def expected_points(average: Column, interval: Column, intervals: int) -> Column:
    """The average, pro-rated to the share of the game that has been played."""
    return average * interval / F.lit(float(intervals))


def stopping_payoff(points: Column, average: Column, interval: Column, intervals: int) -> Column:
    """What stopping now pays: points above the pro-rated average, never negative."""
    return F.greatest(points - expected_points(average, interval, intervals), F.lit(0.0))


def is_alive(interval: Column, intervals: int) -> Column:
    return interval < F.lit(intervals)


def linear_score(features: list[Column], weights: list[float]) -> Column:
    terms = [f.cast("double") * F.lit(float(w)) for f, w in zip(features, weights, strict=True)]
    return sum(terms[1:], terms[0])


def discount(rate: float, expiry: float, steps: int) -> float:
    return math.exp(-rate * expiry / steps)


def put_payoff(price: Column, strike: float) -> Column:
    return F.greatest(F.lit(float(strike)) - price, F.lit(0.0))


def put_target(
    next_price: Column, step: Column, continuation: Column,
    *, strike: float, rate: float, expiry: float, steps: int,
) -> Column:
    """Discounted best of stopping at the next price or, before the last step, going on."""
    stop = put_payoff(next_price, strike)
    best = F.when(step < steps - 1, F.greatest(stop, continuation)).otherwise(stop)
    return best * F.lit(discount(rate, expiry, steps))


def option_basis(t: Column, s: Column, *, strike: float, expiry: float) -> list[Column]:
    """Constant, two damped Laguerre terms in price, three terms in time."""
    moneyness = s / F.lit(float(strike))
    damping = F.exp(-moneyness / 2)
    share = t / F.lit(float(expiry))
    return [
        F.lit(1.0),
        damping,
        damping * (1 - moneyness),
        F.cos(share * (math.pi / 2)),
        F.when(t == expiry, F.lit(0.0)).otherwise(F.ln(F.lit(float(expiry)) - t)),
        share * share,
    ]

"""Training rows and Bellman pairs."""

from pyspark.sql import DataFrame, Window, functions as F

from tipoff.functions import payoff
from tipoff.schema import STATE

EPISODE = ["Player", "GameId"]


def training_rows(
    features: DataFrame, threshold: float = 15, *, average: str = "RollingAvgPlayerPoints",
    state: list[str] = STATE,
) -> DataFrame:
    """Rows above the form threshold with no missing state feature."""
    return features.where(F.col(average) > threshold).na.drop(subset=state)


def add_payoff(
    features: DataFrame, intervals: int = 4, *, points: str = "CumulativePlayerPointsInterval",
    average: str = "RollingAvgPlayerPoints", interval: str = "Interval",
) -> DataFrame:
    """Stopping payoff, and whether the game goes on after this row."""
    step = F.col(interval)
    return features.withColumns({
        "Payoff": payoff.stopping_payoff(F.col(points), F.col(average), step, intervals),
        "Alive": payoff.is_alive(step, intervals),
    })


def expected_path(
    features: DataFrame, intervals: int = 4, *, points: str = "CumulativePlayerPointsInterval",
    average: str = "RollingAvgPlayerPoints", interval: str = "Interval",
) -> DataFrame:
    """Pro-rated expectation and how far the actual score is above it."""
    expected = payoff.expected_points(F.col(average), F.col(interval), intervals)
    return features.withColumn("ExpectedPoints", expected).withColumn(
        "PathPayoff", F.col(points) - F.col("ExpectedPoints")
    )


def state_vector(state: list[str] = STATE):
    return F.array(*[F.col(c).cast("double") for c in state])


def bellman_pairs(
    rows: DataFrame, keys: list[str] = EPISODE, order: str = "Interval",
    state: list[str] = STATE,
) -> DataFrame:
    """Add the state vector and that of the episode's next row (zeros after the last).

    An episode has one row per interval, so its window is small by construction.
    """
    following = F.lead("Phi").over(Window.partitionBy(*keys).orderBy(order))
    zeros = F.array(*[F.lit(0.0)] * len(state))
    return rows.withColumn("Phi", state_vector(state)).withColumn(
        "PhiNext", F.coalesce(following, zeros)
    )

"""From interval arrays to one row per interval, with margin features."""

from pyspark.sql import Column, DataFrame, functions as F

from tipoff.functions.clock import GAME_SECONDS, minutes_left

LEVELS = ("Player", "Team", "Opponent")


def stack_intervals(wide: DataFrame, intervals: int, statistic: str = "Points") -> DataFrame:
    """Rows for interval 0 (all zero) to n, in one narrow pass."""
    arrays = {level: f"Cumulative{level}{statistic}" for level in LEVELS}

    def row(i):
        values = [
            (F.col(a)[i - 1].cast("double") if i else F.lit(0.0)).alias(f"{a}Interval")
            for a in arrays.values()
        ]
        return F.struct(F.lit(i).cast("int").alias("Interval"), *values)

    rest = [c for c in wide.columns if c not in arrays.values() and c != f"CumulativeTotal{statistic}"]
    return wide.select(*rest, F.inline(F.array(*[row(i) for i in range(intervals + 1)])))


def interval_features(
    stacked: DataFrame, intervals: int, statistic: str = "Points", *, game_seconds: int = GAME_SECONDS
) -> DataFrame:
    """Score margin, and its size times the minutes left and their square; 0 at the start."""
    left = F.array(*[F.lit(float(m)) for m in minutes_left(intervals, game_seconds)])
    margin = F.col(f"CumulativeTeam{statistic}Interval") - F.col(f"CumulativeOpponent{statistic}Interval")
    minutes = left[F.col("Interval")]
    return stacked.withColumn("ScoreMarginInterval", margin).withColumns({
        "ScoreMarginxTimeRemainingInterval": F.abs("ScoreMarginInterval") * minutes,
        "ScoreMarginxTimeRemaining2Interval": F.abs("ScoreMarginInterval") * minutes * minutes,
    })


def interval_values(
    i: int, intervals: int, statistic: str = "Points", *, game_seconds: int = GAME_SECONDS
) -> dict[str, Column]:
    """The columns of :func:`stack_intervals` and :func:`interval_features` for one interval, from the arrays."""
    score = {
        level: F.col(f"Cumulative{level}{statistic}")[i - 1].cast("double") if i else F.lit(0.0) for level in LEVELS
    }
    margin = score["Team"] - score["Opponent"]
    minutes = float(minutes_left(intervals, game_seconds)[i])
    return {
        "Interval": F.lit(i).cast("int"),
        **{f"Cumulative{level}{statistic}Interval": value for level, value in score.items()},
        "ScoreMarginInterval": margin,
        "ScoreMarginxTimeRemainingInterval": F.abs(margin) * minutes,
        "ScoreMarginxTimeRemaining2Interval": F.abs(margin) * minutes * minutes,
    }

"""Game clock as column expressions."""

from pyspark.sql import Column, functions as F

# Length of the game and of its periods, in seconds.
REGULATION_PERIODS = 4
PERIOD_SECONDS = 720
OVERTIME_SECONDS = 300
GAME_SECONDS = REGULATION_PERIODS * PERIOD_SECONDS


def clip(value, low=None, high=None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    return value


def elapsed_seconds(quarter: Column, sec_left: Column, overtime: str = "reference") -> Column:
    """Seconds played so far.

    ``reference`` starts overtime one period early, so it overlaps the last
    quarter; ``after_regulation`` starts it when regulation ends.
    """
    first_overtime = REGULATION_PERIODS + 1
    overtime_start = {
        "reference": GAME_SECONDS - PERIOD_SECONDS,
        "after_regulation": GAME_SECONDS,
    }[overtime]
    regulation = clip(quarter, low=1) * PERIOD_SECONDS - sec_left
    extra = overtime_start + (quarter - first_overtime + 1) * OVERTIME_SECONDS - sec_left
    return F.when(quarter <= REGULATION_PERIODS, regulation).otherwise(extra).cast("int")


def remaining_seconds(quarter: Column, sec_left: Column) -> Column:
    """Regulation seconds left; overtime counts only its own clock."""
    full_periods = REGULATION_PERIODS - clip(quarter, 1, REGULATION_PERIODS)
    return (full_periods * PERIOD_SECONDS + sec_left).cast("int")


def interval_cuts(intervals: int, game_seconds: int = GAME_SECONDS) -> list:
    """Inclusive upper bound of each interval; the last one is open (None)."""
    return [game_seconds / intervals * i for i in range(1, intervals)] + [None]


def minutes_left(intervals: int, game_seconds: int = GAME_SECONDS) -> list:
    """Minutes left after interval 0..n; the last is exactly 0."""
    return [game_seconds * (1 - i / intervals) / 60 for i in range(intervals)] + [0.0]

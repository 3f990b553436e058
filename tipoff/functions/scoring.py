"""Who played, who shot and what it was worth, as column expressions."""

from pyspark.sql import Column, functions as F

# Words the play log uses.
MADE = "make"
THREE_PREFIX = "3"
REGULAR = "regular"


def home_flag(home_play: Column) -> Column:
    """1 when the home side has the play; a null entry is data and means away."""
    return F.when(home_play.isNull(), 0).otherwise(1)


def side_team(home: Column, home_team: Column, away_team: Column) -> Column:
    return F.when(home == 1, home_team).otherwise(away_team)


def is_attempt(free_throw: Column, shot: Column) -> Column:
    return free_throw.isNotNull() | shot.isNotNull()


def shooter(free_throw: Column, free_throw_shooter: Column, shot_shooter: Column) -> Column:
    return F.when(free_throw.isNull(), shot_shooter).otherwise(free_throw_shooter)


def potential_points(free_throw: Column, shot_type: Column) -> Column:
    """One for a free throw, else three or two; a missing shot type is worth three."""
    three = F.coalesce(shot_type.startswith(THREE_PREFIX), F.lit(True))
    return F.when(free_throw.isNotNull(), 1).when(three, 3).otherwise(2)


def scored_points(free_throw: Column, shot: Column, shot_type: Column) -> Column:
    """Points of the play. With both outcomes present a made shot still counts, at one point."""
    made = free_throw.eqNullSafe(F.lit(MADE)) | shot.eqNullSafe(F.lit(MADE))
    return F.when(made, potential_points(free_throw, shot_type)).otherwise(0)

"""Play-level columns: clock, sides, shooters and points. All narrow."""

from pyspark.sql import DataFrame, functions as F

from tipoff.functions import clock, scoring
from tipoff.limits import DEFAULT, Limits
from tipoff.operators.joins import join_dimension
from tipoff.schema import GAME


def add_game_clock(plays: DataFrame, *, overtime: str = "reference") -> DataFrame:
    quarter, left = F.col("Quarter"), F.col("SecLeft")
    return plays.withColumns({
        "TimeElapsed": clock.elapsed_seconds(quarter, left, overtime),
        "TimeRemaining": clock.remaining_seconds(quarter, left),
    })


def key_dates(plays: DataFrame) -> DataFrame:
    """Keep the date text as ``DateKey``; game ids sort by it."""
    return plays.withColumnRenamed("Date", "DateKey")


def parse_dates(df: DataFrame, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Parse ``DateKey`` into ``Date``; bad text is null (:mod:`tipoff.operators.dates` has other ways). Cheapest on one row per game."""
    return df.withColumn("Date", F.try_to_date("DateKey", fmt))


def attribute_plays(plays: DataFrame, *, opponent: str = "reference") -> DataFrame:
    """Add Home, Team and Opponent.

    ``reference`` gives the opponent the team's own name; ``true`` the other side's.
    """
    flag = scoring.home_flag(F.col("HomePlay"))
    home_team, away_team = F.col("HomeTeam"), F.col("AwayTeam")
    other = {"reference": F.col("Home"), "true": 1 - F.col("Home")}[opponent]
    return (
        plays.withColumn("Home", flag)
        .withColumn("Team", scoring.side_team(F.col("Home"), home_team, away_team))
        .withColumn("Opponent", scoring.side_team(other, home_team, away_team))
    )


def regular_only(plays: DataFrame) -> DataFrame:
    return plays.where(F.col("GameType") == scoring.REGULAR)


def add_points(plays: DataFrame) -> DataFrame:
    """Player, PotentialPoints and Points; only meaningful on scoring attempts."""
    free_throw, shot, kind = F.col("FreeThrowOutcome"), F.col("ShotOutcome"), F.col("ShotType")
    return plays.withColumns({
        "Player": scoring.shooter(free_throw, F.col("FreeThrowShooter"), F.col("Shooter")),
        "PotentialPoints": scoring.potential_points(free_throw, kind),
        "Points": scoring.scored_points(free_throw, shot, kind),
    })


def scoring_events(plays: DataFrame) -> DataFrame:
    attempt = scoring.is_attempt(F.col("FreeThrowOutcome"), F.col("ShotOutcome"))
    return add_points(plays.where(attempt))


def attach_rest(
    plays: DataFrame, rest: DataFrame, *, game: list[str] = GAME,
    limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Join each play with its team's and its opponent's days of rest.

    ``rest`` says how many plays a team has in a game (``Plays``) and how many
    name it as opponent (``Faced``), which decides whether they are spread over
    tasks. An opponent without a single play in the game has no rest, and
    leaves null. ``row_bound``: rows of ``rest``, where known.
    """
    own = rest.select(*game, "Team", "TeamRest", "Plays")
    other = rest.select(
        *game, F.col("Team").alias("Opponent"), F.col("TeamRest").alias("OpponentTeamRest"), "Faced"
    )
    with_own = join_dimension(
        plays, own, [*game, "Team"], rows="Plays", spread="PlaySeq", limits=limits, row_bound=row_bound
    )
    return join_dimension(
        with_own, other, [*game, "Opponent"], rows="Faced", spread="PlaySeq", how="left",
        limits=limits, row_bound=row_bound,
    )


def team_plays(plays: DataFrame, *, game: list[str] = GAME) -> DataFrame:
    """Per game and team with a play: its plays, and those that name it as opponent, from one pass."""
    pairs = plays.groupBy(*game, "Team", "Opponent").agg(F.count("*").alias("_n"))
    roles = pairs.select(*game, F.inline(F.array(
        F.struct(F.col("Team"), F.col("_n").alias("Plays"), F.lit(0).cast("long").alias("Faced")),
        F.struct(F.col("Opponent").alias("Team"), F.lit(0).cast("long").alias("Plays"), F.col("_n").alias("Faced")),
    )))
    counts = roles.groupBy(*game, "Team").agg(F.sum("Plays").alias("Plays"), F.sum("Faced").alias("Faced"))
    return counts.where(F.col("Plays") > 0)

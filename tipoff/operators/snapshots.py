"""Scores at the end of each interval, by partial aggregation instead of per-game sorts.

A running total of a statistic without negative values never falls, so its
largest value up to a cut is the conditional sum up to that cut; a negative
value is an error. Only the opponent's score needs the order of plays: it is
read at the team's own last attempt. One pass finds those last attempts per
game and side, a second sums the other side's points up to them. Neither pass
sorts plays or gathers a game in one task, so the size of a single game does
not matter.

For a statistic that may fall (``running``), the largest running totals need
the order of plays (:func:`running_tables`); the totals as of a cut are signed
sums up to it, again by partial aggregation.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tipoff.functions.clock import GAME_SECONDS, interval_cuts
from tipoff.limits import DEFAULT, Limits
from tipoff.operators.joins import join_dimension
from tipoff.operators.ordered import running_sums
from tipoff.schema import GAME
from tipoff.session import materialize, materialize_counted

SEQUENCE_LIMIT = 1 << 47  # play sequence numbers of ordinary games are 0 <= n < limit
SIDES = {"Home": 1, "Away": 0}


def clock_bits(game_seconds: int) -> int:
    """Bits for the clock: at least 16, and room for eight times the game."""
    return max(16, int(8 * game_seconds).bit_length())


def play_order(
    elapsed: str = "TimeElapsed", seq: str = "PlaySeq", *, game_seconds: int = GAME_SECONDS
) -> Column:
    """Clock first, then play sequence, packed in one long so aggregates stay hash-based.

    Null for a null clock or sequence; a value that does not fit its bits is an error.
    """
    bits = clock_bits(game_seconds)
    seq_bits = 63 - bits
    time, number = F.col(elapsed).cast("long"), F.col(seq).cast("long")
    fail = lambda text: F.raise_error(F.lit(text)).cast("long")
    return (
        F.when(time.isNull() | number.isNull(), F.lit(None).cast("long"))
        .when(~time.between(0, (1 << bits) - 1), fail(f"game clock outside 0..2^{bits}"))
        .when(~number.between(0, (1 << seq_bits) - 1), fail(f"play sequence outside 0..2^{seq_bits}"))
        .otherwise(F.shiftleft(time, seq_bits) + number)
    )


def running_points(
    plays: DataFrame, statistic: str = "Points",
    *, game: list[str] = GAME, limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Running totals of player, game and team per play, and the opponent's as the difference.

    Without a ``row_bound`` that rules hot games out, ``plays`` is read once
    more to look for them; pass a written table then.
    """
    levels = {"Total": [], "Team": ["Team"], "Player": ["Player"]}
    result = running_sums(
        plays.na.drop(subset=game), game, ["TimeElapsed", "PlaySeq"], statistic,
        {f"Cumulative{level}{statistic}": extra for level, extra in levels.items()},
        limits=limits, row_bound=row_bound,
    )
    opponent = F.col(f"CumulativeTotal{statistic}") - F.col(f"CumulativeTeam{statistic}")
    return result.withColumn(f"CumulativeOpponent{statistic}", opponent)


def _up_to(cut, value):
    """``value`` of plays up to a cut; a play without a clock is up to none."""
    clock = F.col("TimeElapsed")
    return F.when(clock.isNotNull() if cut is None else clock <= cut, value)


def _counted(statistic: str, signed: bool = False) -> Column:
    """The statistic of plays that count, in a type that keeps fractions; it must not fall unless ``signed``."""
    value = F.col(statistic)
    whole = value if signed else F.when(value < 0, F.raise_error(F.lit(f"negative {statistic}: use running=True")).cast("long")).otherwise(value)
    return F.when(F.col("Counted"), whole).otherwise(0)


def play_summary(
    plays: DataFrame, cuts: list, statistic: str = "Points",
    *, game: list[str] = GAME, game_seconds: int = GAME_SECONDS, signed: bool = False,
) -> DataFrame:
    """One row per game, side and player with everything later steps need from the plays.

    ``Counted`` marks the plays that score; the others are kept under a null
    player, because rest days and game ids also see games without them. Games
    with a null key drop out here, after the plays have been folded.
    """
    counted = F.col("Counted")
    player = F.when(counted, F.col("Player")).alias("Player")
    order = F.when(counted, F.col("_order"))
    points = _counted(statistic, signed)
    sums = [F.coalesce(F.sum(_up_to(c, points)), F.lit(0)).alias(f"_sum{i}") for i, c in enumerate(cuts)]
    lasts = [F.max(_up_to(c, order)).alias(f"_last{i}") for i, c in enumerate(cuts)]
    return plays.withColumn("_order", play_order(game_seconds=game_seconds)).groupBy(*game, "Home", player).agg(
        F.min("Season").alias("Season"),
        F.min(order).alias("_first"),
        F.count("*").alias("Plays"),
        *sums,
        *lasts,
    ).na.drop(subset=game)


def game_summary(summary: DataFrame, intervals: int, *, game: list[str] = GAME) -> DataFrame:
    """One row per game: both sides' interval scores and last attempts, and row counts."""
    columns = []
    for side, flag in SIDES.items():
        here = F.col("Home") == flag
        columns.append(F.coalesce(F.bool_or(here), F.lit(False)).alias(f"{side}Present"))
        for i in range(intervals):
            total = F.sum(F.when(here, F.col(f"_sum{i}")).otherwise(0))
            columns.append(total.alias(f"_{side}{i}"))
            columns.append(F.max(F.when(here, F.col(f"_last{i}"))).alias(f"_{side}Last{i}"))
    return summary.groupBy(*game).agg(
        F.min("Season").alias("Season"),
        F.sum("Plays").alias("Plays"),
        F.count("Player").alias("Players"),
        *columns,
    )


def opponent_snapshots(
    plays: DataFrame, games: DataFrame, intervals: int, statistic: str = "Points",
    *, game: list[str] = GAME, game_seconds: int = GAME_SECONDS,
    limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Per game, the other side's points up to each side's last attempt in each interval."""
    last_attempts = games.select(
        *game, "Plays", *[f"_{side}Last{i}" for side in SIDES for i in range(intervals)]
    )
    scored = plays.where(F.col("Counted") & (F.col(statistic) != 0)).select(
        *game, "Home", "PlaySeq", play_order(game_seconds=game_seconds).alias("_order"),
        F.col(statistic).alias("_points"),
    )
    joined = join_dimension(
        scored, last_attempts, game, rows="Plays", spread="PlaySeq",
        limits=limits, row_bound=row_bound,
    )
    sums = []
    for side, flag in SIDES.items():
        for i in range(intervals):
            seen = (F.col("Home") != flag) & (F.col("_order") <= F.col(f"_{side}Last{i}"))
            sums.append(F.sum(F.when(seen, F.col("_points")).otherwise(0)).alias(f"_{side}Opp{i}"))
    return joined.groupBy(*game).agg(*sums)


def score_arrays(
    games: DataFrame, opponents: DataFrame | None, intervals: int, statistic: str = "Points",
    *, game: list[str] = GAME,
) -> DataFrame:
    """Pack the per-interval columns of a game into arrays.

    ``opponents`` None takes the opponent's score at the cut itself.
    """
    if opponents is not None:
        games = games.join(opponents, game, "left")
    columns = {}
    for side in SIDES:
        other = "Away" if side == "Home" else "Home"
        pattern = f"_{side}Opp{{}}" if opponents is not None else f"_{other}{{}}"
        columns[f"{side}Team{statistic}"] = F.array(*[f"_{side}{i}" for i in range(intervals)])
        columns[f"{side}Opponent{statistic}"] = F.array(*[
            F.coalesce(F.col(pattern.format(i)), F.lit(0)) for i in range(intervals)
        ])
    kept = [*game, "Season", "Plays", "Players", "HomePresent", "AwayPresent"]
    played = F.col(f"_HomeLast{intervals - 1}").isNotNull() | F.col(f"_AwayLast{intervals - 1}").isNotNull()
    return games.select(
        *kept, played.alias("HasAttempts"), *[c.alias(n) for n, c in columns.items()]
    )


def player_snapshots(
    summary: DataFrame, intervals: int, statistic: str = "Points", *, game: list[str] = GAME
) -> DataFrame:
    """One row per player and game with the player's score at each cut and the side of the first play."""
    sums = [F.sum(f"_sum{i}") for i in range(intervals)]
    return summary.where(F.col("Player").isNotNull()).groupBy("Player", *game).agg(
        F.min("Season").alias("Season"),
        F.min_by("Home", "_first").alias("Home"),
        F.array(*sums).alias(f"CumulativePlayer{statistic}"),
    )


def attach_scores(
    players: DataFrame, games: DataFrame, statistic: str = "Points",
    *, game: list[str] = GAME, limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Join players with their game and keep the arrays of the player's own side."""
    joined = join_dimension(
        players, games.drop("Season", "Plays"), game, rows="Players", spread="Player",
        limits=limits, row_bound=row_bound,
    )
    home = F.col("Home") == 1
    sides = {
        f"Cumulative{kind}{statistic}": F.when(home, F.col(f"Home{kind}{statistic}"))
        .otherwise(F.col(f"Away{kind}{statistic}"))
        for kind in ("Team", "Opponent")
    }
    total = F.col(f"Total{statistic}") if f"Total{statistic}" in games.columns else F.zip_with(
        f"HomeTeam{statistic}", f"AwayTeam{statistic}", lambda h, a: h + a
    )
    return joined.withColumns({**sides, f"CumulativeTotal{statistic}": total}).drop(
        f"Total{statistic}", *[f"{side}{kind}{statistic}" for side in SIDES for kind in ("Team", "Opponent")]
    )


@dataclass(frozen=True)
class ScoreTables:
    """Written tables and their row counts: players in games (folded plays, or finished rows), and games."""

    summary: DataFrame
    games: DataFrame
    summary_rows: int
    game_rows: int
    finished: bool = False

    def players(self, intervals: int, statistic: str, game: list[str]) -> DataFrame:
        """One row per player and game with the player's score at each cut."""
        return self.summary if self.finished else player_snapshots(self.summary, intervals, statistic, game=game)


def running_tables(
    plays: DataFrame, intervals: int, statistic: str = "Points",
    *, game: list[str] = GAME, game_seconds: int = GAME_SECONDS, limits: Limits = DEFAULT,
) -> ScoreTables:
    """The tables of :func:`score_tables` for a statistic that may fall, by its largest running totals.

    Every value is the largest running total up to the cut (0 without a play);
    the opponent's is the largest that the team's own plays saw. Plays are
    ordered per game by :func:`running_points`, which splits hot games; all
    else is partial aggregation. A side without attempts has null arrays.
    """
    cuts = interval_cuts(intervals, game_seconds)
    order = play_order(game_seconds=game_seconds)
    # Plays without a clock keep their place before all others, and are up to no cut.
    needed = [*game, "Season", "Home", "Team", "Player", "TimeElapsed", "PlaySeq", statistic]
    counted, rows = materialize_counted(plays.where("Counted").select(*needed, order.alias("_order")))
    running = running_points(counted, statistic, game=game, limits=limits, row_bound=rows)

    def highest(level):
        return [F.max(_up_to(c, F.col(f"Cumulative{level}{statistic}"))) for c in cuts]

    # One pass over the ordered plays serves players, sides and games.
    each = materialize(running.groupBy(*game, "Home", "Player").agg(
        F.min("Season").alias("Season"), F.min("_order").alias("_first"),
        *[c.alias(f"_{level}{i}") for level in ("Player", "Team", "Opponent", "Total") for i, c in enumerate(highest(level))],
    ))
    most = lambda level: [F.max(f"_{level}{i}") for i in range(intervals)]
    top = lambda level: F.array(*[F.coalesce(m, F.lit(0)) for m in most(level)])
    players, n = materialize_counted(each.where(F.col("Player").isNotNull()).groupBy("Player", *game).agg(
        F.min("Season").alias("Season"), F.min_by("Home", "_first").alias("Home"), top("Player").alias(f"CumulativePlayer{statistic}"),
    ))
    sides = each.groupBy(*game, "Home").agg(
        top("Team").alias("_Team"), top("Opponent").alias("_Opponent"), F.array(*most("Total")).alias("_Total"), F.count("Player").alias("_players"),
        F.max(f"_Total{intervals - 1}").isNotNull().alias("_played"),
    )
    own = lambda column, flag: F.max(F.when(F.col("Home") == flag, F.col(column)))
    scores = sides.groupBy(*game).agg(
        F.sum("_players").alias("Players"), F.bool_or("_played").alias("HasAttempts"),
        *[own(f"_{kind}", flag).alias(f"{side}{kind}{statistic}") for side, flag in SIDES.items() for kind in ("Team", "Opponent")],
        # A side without a play up to a cut has no total there, which is not a total of 0.
        F.array(*[F.coalesce(F.max(F.col("_Total")[i]), F.lit(0)) for i in range(intervals)]).alias(f"Total{statistic}"),
    )
    everything = plays.groupBy(*game).agg(
        F.min("Season").alias("Season"), F.count("*").alias("Plays"),
        *[F.coalesce(F.bool_or(F.col("Home") == flag), F.lit(False)).alias(f"{side}Present") for side, flag in SIDES.items()],
    ).na.drop(subset=game)
    games, game_rows = materialize_counted(
        everything.join(scores, game, "left").fillna(0, ["Players"]).fillna(False, ["HasAttempts"])
    )
    return ScoreTables(players, games, n, game_rows, finished=True)


def score_tables(
    plays: DataFrame, intervals: int, statistic: str = "Points",
    *, game: list[str] = GAME, game_seconds: int = GAME_SECONDS,
    opponent_score: str = "at_last_play", running: bool = False, limits: Limits = DEFAULT,
) -> ScoreTables:
    """The per-player summary and the per-game score arrays.

    ``running`` is for statistics that may fall: the largest running totals, or
    with the opponent's score ``at_cut`` all totals as they are at the cut.
    """
    if opponent_score not in ("at_last_play", "at_cut"):
        raise ValueError(f"unknown opponent_score {opponent_score!r}")
    if running and opponent_score == "at_last_play":
        return running_tables(plays, intervals, statistic, game=game, game_seconds=game_seconds, limits=limits)
    cuts = interval_cuts(intervals, game_seconds)
    folded = play_summary(plays, cuts, statistic, game=game, game_seconds=game_seconds, signed=running)
    summary, rows = materialize_counted(folded)
    games = game_summary(summary, intervals, game=game)
    opponents = None
    if opponent_score == "at_last_play":
        opponents = opponent_snapshots(
            plays, games, intervals, statistic, game=game, game_seconds=game_seconds, limits=limits, row_bound=rows
        )
    arrays = score_arrays(games, opponents, intervals, statistic, game=game)
    games, game_rows = materialize_counted(arrays)
    return ScoreTables(summary, games, rows, game_rows)


def interval_snapshots(
    plays: DataFrame, intervals: int = 2, statistic: str = "Points",
    *, game: list[str] = GAME, game_seconds: int = GAME_SECONDS,
    opponent_score: str = "at_last_play", running: bool = False, limits: Limits = DEFAULT,
) -> DataFrame:
    """Player, total, team and opponent scores as arrays, one row per player and game.

    ``running`` is for a statistic with negative values, see :func:`score_tables`.
    """
    tables = score_tables(
        plays, intervals, statistic, game=game, game_seconds=game_seconds,
        opponent_score=opponent_score, running=running, limits=limits,
    )
    return attach_scores(
        tables.players(intervals, statistic, game), tables.games, statistic, game=game, limits=limits, row_bound=tables.game_rows
    ).drop("HasAttempts", "HomePresent", "AwayPresent", "Players")

"""From a raw play log to the processed feature table."""

from pyspark.sql import DataFrame, functions as F

from tipoff.functions import scoring
from tipoff.functions.clock import GAME_SECONDS
from tipoff.limits import DEFAULT, Limits
from tipoff.operators import form, keys, plays as play_ops, snapshots, stack
from tipoff.operators.dates import Dates, dates_of
from tipoff.schema import FEATURE_TABLE, GAME, STATE


def prepare_plays(raw: DataFrame, *, overtime: str = "reference", opponent: str = "reference") -> DataFrame:
    """Clock, sides, shooters and points for every play; ``Counted`` marks regular attempts."""
    timed = play_ops.add_game_clock(play_ops.key_dates(raw), overtime=overtime)
    scored = play_ops.add_points(play_ops.attribute_plays(timed, opponent=opponent))
    attempt = scoring.is_attempt(F.col("FreeThrowOutcome"), F.col("ShotOutcome"))
    regular = F.coalesce(F.col("GameType") == scoring.REGULAR, F.lit(False))
    return scored.withColumn("Counted", attempt & regular)


def team_rest(
    games: DataFrame, *, game: list[str] = GAME, cap: int = 4,
    limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Days of rest per game and team; ``games`` says which sides were present."""
    sides = F.array(*[
        F.when(F.col(f"{side}Present"), F.struct(
            F.col(f"{side}Team").alias("Team"), F.lit(flag).alias("Home")
        ))
        for side, flag in snapshots.SIDES.items()
    ])
    teams = games.select(*game, "Date", "Plays", F.inline(F.array_compact(sides)))
    return form.days_rest(teams, "Team", "Date", order=game, cap=cap, limits=limits, row_bound=row_bound)


def game_features(
    games: DataFrame, intervals: int, statistic: str = "Points",
    *, game: list[str] = GAME, span: float = 5, team_total: str = "either",
    include_current: bool = True, limits: Limits = DEFAULT, game_rows: int | None = None,
) -> DataFrame:
    """Per game: id, rest of both sides, form of both sides."""
    sides = None if game_rows is None else len(snapshots.SIDES) * game_rows
    rest = team_rest(games, game=game, limits=limits, row_bound=sides).groupBy(*game).agg(*[
        F.max(F.when(F.col("Home") == flag, F.col("TeamRest"))).alias(f"{side}Rest")
        for side, flag in snapshots.SIDES.items()
    ])
    ids = keys.group_ordinal(games, game, "GameId", limits=limits, row_bound=game_rows)
    finals = games.where("HasAttempts").select(*game, "Date", *[
        F.element_at(f"{side}{kind}{statistic}", intervals).alias(f"{side}{kind}{statistic}")
        for side in snapshots.SIDES for kind in ("Team", "Opponent")
    ])
    forms = form.team_form(
        finals, statistic, game=game, team_total=team_total, span=span,
        include_current=include_current, limits=limits, row_bound=game_rows,
    )
    wanted = [c for c in forms.columns if c.startswith("RollingAvg")]
    return forms.select(*game, *wanted).join(rest, game).join(ids, game)


def build_features(
    raw: DataFrame, intervals: int = 4, min_games: int = 10, season: int | None = 2018,
    statistic: str = "Points",
    *, game: list[str] = GAME, game_seconds: int = GAME_SECONDS, span: float = 5,
    overtime: str = "reference", opponent: str = "reference", opponent_score: str = "at_last_play",
    team_total: str = "either", include_current: bool = True, order_by: list[str] | None = None,
    date_format: str | list[str] | Dates = "yyyy-MM-dd", running: bool = False, paired: bool = False, limits: Limits = DEFAULT,
) -> DataFrame:
    """The processed table: one row per eligible player, game and interval 0..n.

    Rest, form and game numbers see every season; eligibility is cut last.
    ``running`` is for a statistic that may fall: scores and form take its
    largest running totals, or with the opponent's score ``at_cut`` the totals
    as they are at each cut. ``date_format`` may be a list of formats or a
    :class:`~tipoff.operators.dates.Dates`; a date that none reads is an error
    unless that says otherwise. ``paired`` adds the vectors that training needs.
    """
    plays = prepare_plays(raw, overtime=overtime, opponent=opponent)
    players = player_games(
        plays, intervals, statistic, game=game, game_seconds=game_seconds, span=span,
        date_format=date_format, running=running,
        opponent=opponent, opponent_score=opponent_score, team_total=team_total,
        include_current=include_current, order_by=order_by, limits=limits,
    )
    return feature_rows(
        eligible_games(players, min_games, season), intervals, statistic, game_seconds=game_seconds, paired=paired
    )


def eligible_games(players: DataFrame, min_games: int = 10, season: int | None = 2018) -> DataFrame:
    """Players' games after their first ``min_games``, in one season (None keeps all)."""
    eligible = players.where(F.col("PlayerGameNumber") >= min_games)
    return eligible if season is None else eligible.where(F.col("Season") == season)


def feature_rows(
    players: DataFrame, intervals: int, statistic: str = "Points",
    *, game_seconds: int = GAME_SECONDS, paired: bool = False,
) -> DataFrame:
    """One row per interval with margins, cast to the fixed output columns, in one narrow pass.

    ``paired`` adds the state vector and that of the next interval (zeros after
    the last), which stands in the same arrays, so no window is needed.
    """
    kinds = {f.name.replace("Points", statistic): f.dataType for f in FEATURE_TABLE}
    state = [c.replace("Points", statistic) for c in STATE]
    moving = [
        stack.interval_values(i, intervals, statistic, game_seconds=game_seconds) for i in range(intervals + 1)
    ]
    vectors = [F.array(*[here.get(c, F.col(c)).cast("double") for c in state]) for here in moving]
    vectors.append(F.array(*[F.lit(0.0)] * len(state)))
    rows = []
    for i, here in enumerate(moving):
        cells = [value.cast(kinds[c]).alias(c) for c, value in here.items()]
        if paired:
            cells += [vectors[i].alias("Phi"), vectors[i + 1].alias("PhiNext")]
        rows.append(F.struct(*cells))
    fixed = [F.col(c).cast(kind).alias(c) for c, kind in kinds.items() if c not in moving[0]]
    stacked = players.select(*fixed, F.inline(F.array(*rows)))
    return stacked.select(*kinds, *(["Phi", "PhiNext"] if paired else []))


def player_games(
    plays: DataFrame, intervals: int, statistic: str = "Points",
    *, game: list[str] = GAME, game_seconds: int = GAME_SECONDS, span: float = 5,
    opponent: str = "reference", opponent_score: str = "at_last_play", team_total: str = "either",
    include_current: bool = True, order_by: list[str] | None = None,
    date_format: str | list[str] | Dates = "yyyy-MM-dd", running: bool = False, limits: Limits = DEFAULT,
) -> DataFrame:
    """One row per player and game with score arrays, form, rest, ids and game number."""
    tables = snapshots.score_tables(
        plays, intervals, statistic, game=game, game_seconds=game_seconds,
        opponent_score=opponent_score, running=running, limits=limits,
    )
    dates = dates_of(date_format).settled(tables.games.select(*game, "Plays"))
    games = dates.apply(tables.games)
    context = game_features(
        games, intervals, statistic, game=game, span=span, team_total=team_total,
        include_current=include_current, limits=limits, game_rows=tables.game_rows,
    )
    per_game = games.where("HasAttempts").drop("Date").join(context, game)

    arrays = f"CumulativePlayer{statistic}"
    players = dates.apply(tables.players(intervals, statistic, game)).withColumns({"_arrays": F.col(arrays), arrays: F.element_at(arrays, intervals)})
    formed = form.player_form(
        players, statistic, game=game, order_by=order_by, span=span,
        include_current=include_current, limits=limits, row_bound=tables.summary_rows,
    ).withColumn(arrays, F.col("_arrays")).drop("_arrays")

    joined = snapshots.attach_scores(
        formed, per_game, statistic, game=game, limits=limits, row_bound=tables.game_rows
    )
    home = F.col("Home") == 1
    other = home if opponent == "reference" else ~home
    return form.pick_side_form(joined, statistic).withColumns({
        "Team": F.when(home, F.col("HomeTeam")).otherwise(F.col("AwayTeam")),
        "Opponent": F.when(other, F.col("HomeTeam")).otherwise(F.col("AwayTeam")),
        "TeamRest": F.when(home, F.col("HomeRest")).otherwise(F.col("AwayRest")),
        "OpponentTeamRest": F.when(other, F.col("HomeRest")).otherwise(F.col("AwayRest")),
    })

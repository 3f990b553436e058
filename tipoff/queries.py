"""Every operator as a query over the driver's tables: (spark, sf_dir) -> DataFrame."""

from pyspark.sql import functions as F

from tipoff.functions import network, payoff
from tipoff.operators import dates, form, keys, moments, pairs, plays as play_ops, scaling, snapshots, stack
from tipoff.operators.ordered import framed
from tipoff.plans import features as plan, fitted_q, lspi
from tipoff.schema import FEATURE_TABLE, GAME, STATE
from tipoff.session import materialize, materialize_counted, new_path
from tipoff.sources import model_store, play_log, sorted_table
from tipoff.sources.event_log import DATE_FORMAT, SEASONS, plays_from_events

INTERVALS = 4
FORM_THRESHOLD = 2  # the derived log scores lower than a real one
SEED = 100
OPTION = {"strike": 100.0, "expiry": 1.0}
RATE = 0.05
FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy-MM-dd", "d MMM yyyy", "d.M.yyyy"]  # the first misreads some dates of the second
DAYS = 30
FILE_ROWS = 500  # of the sorted feature table, so that it has several files at the smallest size too
WEIGHT_DIGITS = 3  # significant; team, opponent and margin are collinear, so only the ridge pins their weights
HELD_WEIGHTS = [0.0, 0.3] + [0.0] * 11  # go on where three tenths of the next points beat the payoff
Q_STEPS, Q_RATE, Q_DECAY = 20, 0.05, 0.999

# Hypothetical states, one per interval, for a 20-point and a 30-point player.
SCENARIOS = [
    ("twenty", 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 20.0, 112.4, 116.2),
    ("twenty", 1.0, 33.0, 1.0, 1.0, 0.0, 43.0, 21.0, 22.0, 792.0, 28512.0, 20.0, 112.4, 116.2),
    ("twenty", 2.0, 33.0, 1.0, 1.0, 0.0, 75.0, 58.0, 17.0, 408.0, 9792.0, 20.0, 112.4, 116.2),
    ("twenty", 3.0, 38.0, 1.0, 1.0, 0.0, 98.0, 88.0, 10.0, 120.0, 1440.0, 20.0, 112.4, 116.2),
    ("thirty", 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 30.0, 112.4, 116.2),
    ("thirty", 1.0, 15.0, 1.0, 1.0, 0.0, 43.0, 21.0, 22.0, 792.0, 28512.0, 30.0, 112.4, 116.2),
    ("thirty", 2.0, 20.0, 1.0, 1.0, 0.0, 75.0, 58.0, 17.0, 408.0, 9792.0, 30.0, 112.4, 116.2),
    ("thirty", 3.0, 23.0, 1.0, 1.0, 0.0, 98.0, 88.0, 10.0, 120.0, 1440.0, 30.0, 112.4, 116.2),
]

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_plays(spark, sf_dir):
    return plays_from_events(table(spark, sf_dir, "events"))


def prepared(spark, sf_dir, **options):
    return plan.prepare_plays(raw_plays(spark, sf_dir), **options)


def counted(spark, sf_dir):
    return prepared(spark, sf_dir).where("Counted")


def rounded(df, columns=None, digits=6):
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns or doubles})


def player_games(spark, sf_dir, **options):
    return plan.player_games(
        prepared(spark, sf_dir), INTERVALS, date_format=DATE_FORMAT, **options
    )


def feature_table(spark, sf_dir, **options):
    return plan.build_features(raw_plays(spark, sf_dir), INTERVALS, date_format=DATE_FORMAT, **options)


def training(spark, sf_dir):
    return pairs.training_rows(feature_table(spark, sf_dir), FORM_THRESHOLD)


def written_training(spark, sf_dir):
    """For queries that pass over the rows more than once."""
    return materialize(training(spark, sf_dir))


def training_pairs(spark, sf_dir):
    rows = pairs.training_rows(feature_table(spark, sf_dir, paired=True), FORM_THRESHOLD)
    return lspi.prepare_pairs(rows, INTERVALS)


def significant(df, column, digits):
    """``column`` rounded to so many significant digits; 0 stays 0."""
    value = F.col(column)
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return df.withColumn(column, F.when(value == 0, 0.0).otherwise(F.round(value * scale) / scale))


def spread(df, column, names):
    """An array column as one column per name."""
    return df.select(
        *[c for c in df.columns if c != column], *[F.col(column)[i].alias(n) for i, n in enumerate(names)]
    )


# Plays ---------------------------------------------------------------------------------------

@query
def load_plays(spark, sf_dir):
    return raw_plays(spark, sf_dir)


@query
def csv_log_load(spark, sf_dir):
    """One CSV log per season, written and read back with the fixed schema."""
    log = raw_plays(spark, sf_dir)
    paths = {}
    for season in SEASONS:
        paths[season] = new_path(spark)
        log.where(F.col("Season") == season).drop("Season", "PlaySeq").write.csv(paths[season], header=True)
    return play_log.load_plays(spark, paths).drop("PlaySeq")


def checked_log(spark, sf_dir):
    """A CSV log in which some numbers were spoilt, read once."""
    log, path = raw_plays(spark, sf_dir), new_path(spark)
    spoilt = lambda n, c, text: F.when(F.col("PlaySeq") % n == 0, F.lit(text)).otherwise(F.col(c).cast("string"))
    log.withColumns({"Quarter": spoilt(13, "Quarter", "Q?"), "SecLeft": spoilt(29, "SecLeft", "4:5x")}).drop(
        "Season", "PlaySeq"
    ).write.csv(path, header=True)
    return play_log.read_checked(spark, path)


@query
def csv_log_checked(spark, sf_dir):
    """Plays of the rows that could be read."""
    return checked_log(spark, sf_dir).plays


@query
def csv_log_rejected(spark, sf_dir):
    """The other rows, a row per unreadable cell."""
    rejected = checked_log(spark, sf_dir).rejected
    return rejected.select("HomeTeam", "AwayTeam", "Date", "Shooter", "FreeThrowShooter", F.inline("bad"))


@query
def csv_log_counts(spark, sf_dir):
    """What was counted while reading."""
    return checked_log(spark, sf_dir).counts


@query
def union_tagged_seasons(spark, sf_dir):
    log = raw_plays(spark, sf_dir)
    early, late = (log.where(F.col("Season") == s).drop("Season") for s in SEASONS)
    both = play_log.union_seasons({SEASONS[0]: early.drop("ShotType"), SEASONS[1]: late})
    return both.select("PlaySeq", "HomeTeam", "ShotType", "Season")


@query
def game_clock(spark, sf_dir):
    log = raw_plays(spark, sf_dir)
    fixed = play_ops.add_game_clock(log, overtime="after_regulation")
    both = play_ops.add_game_clock(
        fixed.withColumnRenamed("TimeElapsed", "ElapsedAfterRegulation").drop("TimeRemaining")
    )
    return both.select("PlaySeq", "Quarter", "SecLeft", "TimeElapsed", "TimeRemaining", "ElapsedAfterRegulation")


@query
def date_parse(spark, sf_dir):
    dated = play_ops.parse_dates(play_ops.key_dates(raw_plays(spark, sf_dir)), DATE_FORMAT)
    return dated.select("PlaySeq", "DateKey", "Date")


@query
def play_attribution(spark, sf_dir):
    log = raw_plays(spark, sf_dir)
    renamed = play_ops.attribute_plays(log, opponent="true").withColumnRenamed("Opponent", "TrueOpponent")
    return play_ops.attribute_plays(renamed).select("PlaySeq", "Home", "Team", "Opponent", "TrueOpponent")


@query
def regular_only(spark, sf_dir):
    return play_ops.regular_only(raw_plays(spark, sf_dir)).select("PlaySeq", "GameType", "Season")


@query
def scoring_events(spark, sf_dir):
    return play_ops.scoring_events(raw_plays(spark, sf_dir)).select(
        "PlaySeq", "Player", "PotentialPoints", "Points"
    )


@query
def running_points(spark, sf_dir):
    columns = ["PlaySeq", *GAME, "Team", "Player", "TimeElapsed", "Points"]
    plays, rows = materialize_counted(counted(spark, sf_dir).select(columns))
    totals = snapshots.running_points(plays, row_bound=rows)
    levels = ("Player", "Total", "Team", "Opponent")
    return totals.select("PlaySeq", *[f"Cumulative{level}Points" for level in levels])


# Games and keys ------------------------------------------------------------------------------

@query
def game_ordinal(spark, sf_dir):
    log = play_ops.key_dates(raw_plays(spark, sf_dir))
    return keys.group_ordinal(log, GAME, "GameId")


@query
def order_day_ordinal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("DayText")
    )
    return keys.group_ordinal(orders, ["o_custkey", "DayText"], "DayId")


def _team_rest(spark, sf_dir, **options):
    """The plays, the written rest of both teams of every game, and its row count."""
    plays = prepared(spark, sf_dir, **options)
    teams, rows = materialize_counted(play_ops.team_plays(plays))
    dated = play_ops.parse_dates(teams, DATE_FORMAT)
    return plays, form.days_rest(dated, "Team", "Date", order=GAME, row_bound=rows), rows


@query
def rest_days(spark, sf_dir):
    return _team_rest(spark, sf_dir)[1].select(*GAME, "Team", "TeamRest")


@query
def rest_days_joined(spark, sf_dir):
    plays, rest, rows = _team_rest(spark, sf_dir)
    return play_ops.attach_rest(plays, rest, row_bound=rows).select("PlaySeq", "Team", "TeamRest", "OpponentTeamRest")


@query
def rest_days_true_opponent(spark, sf_dir):
    plays, rest, rows = _team_rest(spark, sf_dir, opponent="true")
    return play_ops.attach_rest(plays, rest, row_bound=rows).select(
        "PlaySeq", "Opponent", "TeamRest", "OpponentTeamRest"
    )


@query
def rest_days_orders(spark, sf_dir):
    days, rows = materialize_counted(table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("OrderDay")
    ).distinct())
    return form.days_rest(days, "o_custkey", "OrderDay", out="DaysRest", row_bound=rows)


@query
def first_non_null(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("Part"),
        F.when(F.col("l_linestatus") != "O", F.col("l_linenumber")).cast("long").alias("Line"),
        (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey")).alias("_order"),
    )
    return keys.first_non_null(items, ["l_orderkey"], ["Part", "Line"], F.col("_order"))


# Form ----------------------------------------------------------------------------------------

def _totals(spark, sf_dir):
    totals = form.player_game_totals(counted(spark, sf_dir).where("Player IS NOT NULL"))
    return play_ops.parse_dates(totals, DATE_FORMAT)


def _player_form(spark, sf_dir, **options):
    totals, rows = materialize_counted(_totals(spark, sf_dir))
    return form.player_form(totals, row_bound=rows, **options)


@query
def player_game_totals(spark, sf_dir):
    return _totals(spark, sf_dir)


@query
def player_form(spark, sf_dir):
    formed = _player_form(spark, sf_dir)
    return rounded(formed.select("Player", *GAME, "RollingAvgPlayerPoints"))


@query
def player_form_before_game(spark, sf_dir):
    formed = _player_form(spark, sf_dir, include_current=False, order_by=["Date", *GAME])
    return rounded(formed.select("Player", *GAME, "RollingAvgPlayerPoints", "PlayerGameNumber"))


@query
def player_game_number(spark, sf_dir):
    formed = _player_form(spark, sf_dir)
    return formed.select("Player", *GAME, "PlayerGameNumber")


@query
def ewm_events_daily(spark, sf_dir):
    daily, rows = materialize_counted(table(spark, sf_dir, "events").groupBy(
        "user_id", F.to_date("ts").alias("Day")
    ).agg(F.sum("value").alias("DayValue")))
    return rounded(form.ewm_mean(daily, {"Form": "DayValue"}, ["user_id"], ["Day"], row_bound=rows))


@query
def ewm_events_missing(spark, sf_dir):
    """Days without a purchase have no value, and only let the earlier ones age."""
    spent = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")))
    daily, rows = materialize_counted(table(spark, sf_dir, "events").groupBy(
        "user_id", F.to_date("ts").alias("Day")
    ).agg(spent.alias("Spent")))
    return rounded(form.ewm_mean(daily, {"Form": "Spent"}, ["user_id"], ["Day"], row_bound=rows))


def _final_scores(spark, sf_dir):
    tables = snapshots.score_tables(prepared(spark, sf_dir), INTERVALS)
    games = play_ops.parse_dates(tables.games.where("HasAttempts"), DATE_FORMAT)
    return tables.game_rows, games.select(*GAME, "Date", *[
        F.element_at(f"{side}{kind}Points", INTERVALS).alias(f"{side}{kind}Points")
        for side in snapshots.SIDES for kind in ("Team", "Opponent")
    ])


@query
def team_game_totals(spark, sf_dir):
    _, finals = _final_scores(spark, sf_dir)
    return finals.select(
        *GAME,
        F.greatest("HomeTeamPoints", "AwayTeamPoints").alias("GameTeamPoints"),
        F.greatest("HomeOpponentPoints", "AwayOpponentPoints").alias("GameOpponentPoints"),
    )


def _side_form(spark, sf_dir, **options):
    rows, finals = _final_scores(spark, sf_dir)
    formed = form.team_form(finals, row_bound=rows, **options)
    sides = formed.withColumn("Home", F.explode(F.array(F.lit(0), F.lit(1))))
    wanted = ["RollingAverageTeamPoints", "RollingAverageOpposingTeamAllowedPoints"]
    return rounded(form.pick_side_form(sides).select(*GAME, "Home", *wanted))


@query
def team_form(spark, sf_dir):
    return _side_form(spark, sf_dir)


@query
def team_form_own_before_game(spark, sf_dir):
    return _side_form(spark, sf_dir, team_total="own", include_current=False)


# Intervals and the feature table -------------------------------------------------------------

def _snapshots(spark, sf_dir, **options):
    return snapshots.interval_snapshots(prepared(spark, sf_dir), INTERVALS, **options)


@query
def interval_snapshots(spark, sf_dir):
    return _spread_snapshots(_snapshots(spark, sf_dir), INTERVALS)


@query
def interval_snapshots_at_cut(spark, sf_dir):
    wide = _snapshots(spark, sf_dir, opponent_score="at_cut")
    return wide.select("Player", *GAME, *[
        F.col("CumulativeOpponentPoints")[i].alias(f"CumulativeOpponentPoints_{i + 1}")
        for i in range(INTERVALS)
    ])


def _spread_snapshots(wide, intervals, statistic="Points"):
    levels = ("Player", "Total", "Team", "Opponent")
    return wide.select("Player", *GAME, *[
        F.col(f"Cumulative{level}{statistic}")[i].alias(f"Cumulative{level}{statistic}_{i + 1}")
        for level in levels for i in range(intervals)
    ])


@query
def interval_snapshots_two(spark, sf_dir):
    return _spread_snapshots(snapshots.interval_snapshots(prepared(spark, sf_dir)), 2)


@query
def interval_snapshots_twelve(spark, sf_dir):
    return _spread_snapshots(snapshots.interval_snapshots(prepared(spark, sf_dir), 12), 12)


@query
def interval_snapshots_value(spark, sf_dir):
    """Snapshots of a statistic with fractions."""
    plays = plan.prepare_plays(plays_from_events(table(spark, sf_dir, "events"), Value=F.col("value")))
    return rounded(_spread_snapshots(snapshots.interval_snapshots(plays, INTERVALS, "Value"), INTERVALS, "Value"))


def swing_plays(spark, sf_dir):
    """The log with a whole-number statistic that rises and falls."""
    swing = F.regexp_extract("props", r'"k":\s*(\d+)', 1).try_cast("int") - 50
    return plays_from_events(table(spark, sf_dir, "events"), Swing=swing)


@query
def interval_snapshots_swing(spark, sf_dir):
    """The largest running totals of a statistic that may fall."""
    plays = plan.prepare_plays(swing_plays(spark, sf_dir))
    wide = snapshots.interval_snapshots(plays, INTERVALS, "Swing", running=True)
    return _spread_snapshots(wide, INTERVALS, "Swing")


@query
def interval_snapshots_swing_at_cut(spark, sf_dir):
    """Its running totals as they are at each cut."""
    plays = plan.prepare_plays(swing_plays(spark, sf_dir))
    wide = snapshots.interval_snapshots(plays, INTERVALS, "Swing", running=True, opponent_score="at_cut")
    return _spread_snapshots(wide, INTERVALS, "Swing")


@query
def stack_intervals(spark, sf_dir):
    stacked = stack.stack_intervals(_snapshots(spark, sf_dir), INTERVALS)
    return stacked.select("Player", *GAME, "Interval", *[
        f"Cumulative{level}PointsInterval" for level in stack.LEVELS
    ])


@query
def interval_features(spark, sf_dir):
    stacked = stack.stack_intervals(_snapshots(spark, sf_dir), INTERVALS)
    featured = stack.interval_features(stacked, INTERVALS)
    margins = [c for c in featured.columns if c.startswith("ScoreMargin")]
    return featured.select("Player", *GAME, "Interval", *margins)


@query
def player_game_rows(spark, sf_dir):
    return player_games(spark, sf_dir).select(
        "Player", "GameId", "Season", "Home", "Team", "Opponent", "TeamRest", "OpponentTeamRest"
    )


@query
def eligible_games(spark, sf_dir):
    return plan.eligible_games(player_games(spark, sf_dir)).select("Player", "GameId", "PlayerGameNumber")


@query
def feature_build(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir))


@query
def feature_build_corrected(spark, sf_dir):
    return rounded(feature_table(
        spark, sf_dir, overtime="after_regulation", opponent="true", opponent_score="at_cut",
        team_total="own", include_current=False, order_by=["Date", *GAME],
    ))


@query
def feature_build_swing(spark, sf_dir):
    """The whole build for a statistic that may fall: scores and form by its largest running totals."""
    return rounded(plan.build_features(
        swing_plays(spark, sf_dir), INTERVALS, statistic="Swing", date_format=DATE_FORMAT, running=True
    ))


@query
def feature_build_swing_at_cut(spark, sf_dir):
    """The same by its totals as they are at each cut, each side's own."""
    return rounded(plan.build_features(
        swing_plays(spark, sf_dir), INTERVALS, statistic="Swing", date_format=DATE_FORMAT, running=True,
        opponent_score="at_cut", team_total="own",
    ))


@query
def feature_roundtrip(spark, sf_dir):
    path = new_path(spark)
    play_log.write_features(feature_table(spark, sf_dir), path)
    return rounded(play_log.read_features(spark, path))


@query
def training_rows(spark, sf_dir):
    return rounded(training(spark, sf_dir))


def mixed_dates(spark, sf_dir):
    """The log with dates written in four ways, and some games whose date no format reads."""
    log = raw_plays(spark, sf_dir)
    day = F.try_to_date("Date", DATE_FORMAT)
    style = F.dayofyear(day) % 4
    text = F.when(style == 0, F.date_format(day, "yyyy-MM-dd")).when(style == 1, F.date_format(day, "d MMM yyyy"))
    text = text.when(style == 2, F.date_format(day, "d.M.yyyy")).otherwise(F.col("Date"))
    lost = (F.substring("HomeTeam", 2, 1).cast("int") + F.dayofyear(day)) % 17 == 0
    return log.withColumn("Date", F.when(lost, F.concat(F.lit("day "), F.dayofyear(day))).otherwise(text))


@query
def date_coverage(spark, sf_dir):
    """What each of five formats reads of the plays' dates, and what none does."""
    games = play_ops.key_dates(mixed_dates(spark, sf_dir)).groupBy(*GAME).agg(F.count("*").alias("Plays"))
    return dates.date_coverage(games, FORMATS, weight="Plays")


@query
def date_quarantine(spark, sf_dir):
    """Games that the build leaves out because no format reads their date, and their plays."""
    aside = new_path(spark)
    games = play_ops.key_dates(mixed_dates(spark, sf_dir)).groupBy(*GAME).agg(F.count("*").alias("Plays"))
    dates.Dates(tuple(FORMATS), "quarantine", aside).settled(games)
    return spark.read.parquet(aside)


@query
def feature_build_mixed_dates(spark, sf_dir):
    """The build of that log: formats by coverage, games with unreadable dates left out."""
    return rounded(plan.build_features(
        mixed_dates(spark, sf_dir), INTERVALS, date_format=dates.Dates(tuple(FORMATS), "quarantine")
    ))


def sorted_features(spark, sf_dir):
    """Path of the feature table, written in order in small files."""
    path = new_path(spark)
    sorted_table.write_sorted(feature_table(spark, sf_dir), path, file_rows=FILE_ROWS)
    return path


@query
def player_game_lookup(spark, sf_dir):
    """One player's game, that of the best final score (ties by player and game id), from the files that may hold it."""
    path = sorted_features(spark, sf_dir)
    best = sorted_table.read_sorted(spark, path, FEATURE_TABLE).orderBy(
        F.desc("CumulativePlayerPointsInterval"), F.desc("Interval"), "Player", "GameId"
    ).first()
    return rounded(sorted_table.lookup(spark, path, FEATURE_TABLE, Player=best.Player, GameId=best.GameId))


@query
def sorted_sink(spark, sf_dir):
    """Every row's place when the files of the sorted feature table are read in name order."""
    path = sorted_features(spark, sf_dir)
    return sorted_table.file_positions(spark, path, FEATURE_TABLE).select("Player", "GameId", "Interval", "position")


# Valuation -----------------------------------------------------------------------------------

@query
def stopping_payoff(spark, sf_dir):
    valued = pairs.add_payoff(training(spark, sf_dir), INTERVALS)
    return rounded(valued.select(*pairs.EPISODE, "Interval", "Payoff", "Alive"))


@query
def expected_path(spark, sf_dir):
    path = pairs.expected_path(training(spark, sf_dir), INTERVALS)
    return rounded(path.select(*pairs.EPISODE, "Interval", "ExpectedPoints", "PathPayoff"))


@query
def bellman_pairs(spark, sf_dir):
    paired = training_pairs(spark, sf_dir).select(*pairs.EPISODE, "Interval", "PhiNext")
    return rounded(spread(paired, "PhiNext", [f"Next{c}" for c in STATE]))


@query
def bellman_pairs_by_window(spark, sf_dir):
    """The same pairs from a table of rows, as one read from disk."""
    paired = pairs.bellman_pairs(training(spark, sf_dir)).select(*pairs.EPISODE, "Interval", "PhiNext")
    return rounded(spread(paired, "PhiNext", [f"Next{c}" for c in STATE]))


@query
def feature_stats(spark, sf_dir):
    return rounded(scaling.feature_stats(training(spark, sf_dir)))


@query
def standardized_features(spark, sf_dir):
    rows = written_training(spark, sf_dir)
    scaled = scaling.standardize(rows, scaling.fit_scaling(rows))
    return rounded(scaled.select("Player", "GameId", *STATE))


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query
def lineitem_stats(spark, sf_dir):
    return rounded(scaling.feature_stats(table(spark, sf_dir, "lineitem"), LINE_COLUMNS, untouched=[]))


@query
def lineitem_histogram(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("price"))
    return rounded(scaling.score_histogram(prices, "price"))


@query
def bellman_gram(spark, sf_dir):
    return rounded(lspi.bellman_gram(training_pairs(spark, sf_dir)), digits=1)


EMBEDDING_WIDTH = 64


@query
def embedding_gram(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("v"))
    return rounded(moments.gram_matrix(vectors, "v", "v", (EMBEDDING_WIDTH, EMBEDDING_WIDTH)), digits=5)


@query
def bellman_gram_held(spark, sf_dir):
    """The system of an iteration whose weights make some states go on."""
    return rounded(lspi.bellman_gram(training_pairs(spark, sf_dir), HELD_WEIGHTS), digits=1)


@query
def lspi_weights(spark, sf_dir):
    weights = lspi.weights_table(spark, lspi.lspi_fit(training_pairs(spark, sf_dir)))
    return significant(weights, "weight", WEIGHT_DIGITS)


def _scored_pairs(spark, sf_dir):
    valued = materialize(training_pairs(spark, sf_dir))
    return valued, lspi.lspi_fit(valued)


def _lspi_output(spark, sf_dir):
    valued, policy = _scored_pairs(spark, sf_dir)
    scored = lspi.score_linear(valued, policy)
    return scored.select(*STATE, "Player", "res", F.col("Opponent").alias("Opposition"), "Date",
                         F.col("GameId").alias("Game"))


@query
def lspi_scored(spark, sf_dir):
    return rounded(_lspi_output(spark, sf_dir))


def _written_scores(spark, scored):
    path = new_path(spark)
    play_log.write_scores(scored, path)
    return play_log.read_table(spark, path, scored.schema)


@query
def lspi_output_roundtrip(spark, sf_dir):
    """The scored table of the linear policy as a CSV file, read back."""
    return rounded(_written_scores(spark, _lspi_output(spark, sf_dir)))


@query
def network_output_roundtrip(spark, sf_dir):
    """The scored table of the network as a CSV file, read back."""
    return rounded(_written_scores(spark, _network_scores(spark, sf_dir).select(*STATE, "Player", "res")))


@query
def exercise_policy(spark, sf_dir):
    valued, policy = _scored_pairs(spark, sf_dir)
    decided = lspi.exercise_policy(valued, policy)
    return rounded(decided.select(*pairs.EPISODE, "Interval", "Payoff", "Continuation", "Decision"))


def _network_scores(spark, sf_dir):
    rows = written_training(spark, sf_dir)
    theta = network.initial_parameters(len(STATE), SEED)
    return fitted_q.score_network(rows, theta, scaling=scaling.fit_scaling(rows))


@query
def network_score(spark, sf_dir):
    return rounded(_network_scores(spark, sf_dir).select("Player", "GameId", "Interval", "res"))


@query
def score_histogram(spark, sf_dir):
    return rounded(scaling.score_histogram(materialize(_network_scores(spark, sf_dir)), "res"))


def _scenarios(spark):
    return spark.createDataFrame(SCENARIOS, ", ".join(["Scenario string", *[f"{c} double" for c in STATE]]))


@query
def scenario_price(spark, sf_dir):
    stats = scaling.fit_scaling(training(spark, sf_dir))
    theta = network.initial_parameters(len(STATE), SEED)
    priced = fitted_q.price_scenarios(_scenarios(spark), stats, theta)
    return rounded(priced.select("Scenario", "Interval", "price"))


def _trained(spark, sf_dir):
    rows = written_training(spark, sf_dir)
    stats = scaling.fit_scaling(rows)
    scaled = scaling.standardize(rows, stats)
    fit = fitted_q.fitted_q(
        lspi.prepare_pairs(scaled, INTERVALS), steps=Q_STEPS, rate=Q_RATE, decay=Q_DECAY, seed=SEED
    )
    return stats, fit


@query
def fitted_q_loss(spark, sf_dir):
    return rounded(fitted_q.loss_table(spark, _trained(spark, sf_dir)[1]))


@query
def fitted_q_converged(spark, sf_dir):
    """How training that runs until it settles ends; no SQL counterpart, its steps depend on its own progress."""
    rows = written_training(spark, sf_dir)
    scaled = scaling.standardize(rows, scaling.fit_scaling(rows))
    fit = fitted_q.fit_to_convergence(lspi.prepare_pairs(scaled, INTERVALS), seed=SEED)
    state = [(len(fit.losses), fit.losses[0], fit.losses[-1], fit.converged, fit.stalled)]
    return spark.createDataFrame(state, "evaluations int, first_loss double, last_loss double, converged boolean, stalled boolean")


def stored_model(spark, sf_dir):
    """A network trained to its end, written as a version of a model table and read from there; and the training rows."""
    rows, path = written_training(spark, sf_dir), new_path(spark)
    stats = scaling.fit_scaling(rows)
    pairs_of = lspi.prepare_pairs(scaling.standardize(rows, stats), INTERVALS)
    fit = fitted_q.fit_to_convergence(pairs_of, seed=SEED, progress=f"{path}/progress")
    facts = {"evaluations": len(fit.losses), "loss": fit.losses[-1], "converged": fit.converged, "stalled": fit.stalled}
    version = model_store.save_model(spark, f"{path}/models", fit.theta, stats, facts)
    return model_store.load_model(spark, f"{path}/models", version), rows


@query
def network_score_converged(spark, sf_dir):
    """Every training row scored by the stored network; no SQL counterpart, as above."""
    model, rows = stored_model(spark, sf_dir)
    return fitted_q.score_model(rows, model).select("Player", "GameId", "Interval", "res")


@query
def scenario_price_converged(spark, sf_dir):
    """The hypothetical states priced by the stored network; no SQL counterpart, as above."""
    model, _ = stored_model(spark, sf_dir)
    return fitted_q.score_model(_scenarios(spark), model, "price").select("Scenario", "Interval", "price")


@query
def scenario_price_trained(spark, sf_dir):
    stats, fit = _trained(spark, sf_dir)
    priced = fitted_q.price_scenarios(_scenarios(spark), stats, fit.theta)
    return rounded(priced.select("Scenario", "Interval", "price"))


# Option columns ------------------------------------------------------------------------------

@query
def option_basis(spark, sf_dir):
    ts = F.col("ts")
    t = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / F.lit(86400.0)
    terms = payoff.option_basis(t, F.col("value"), **OPTION)
    return rounded(table(spark, sf_dir, "events").select(
        "event_id", *[term.alias(f"basis_{i}") for i, term in enumerate(terms)]
    ))


@query
def put_target(spark, sf_dir):
    """Daily value of each user as a price path; the going-on value is the sum of the basis terms."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    daily, rows = materialize_counted(
        table(spark, sf_dir, "events").groupBy("user_id", day.alias("step")).agg(F.sum("value").alias("price"))
    )
    path = framed(
        daily, ["user_id"], ["step"], {"next_price": lambda w: F.lead("price").over(w)},
        after=1, row_bound=rows,
    ).where(F.col("next_price").isNotNull())
    t_next = (F.col("step") + 1) / F.lit(float(DAYS))
    terms = payoff.option_basis(t_next, F.col("next_price"), **OPTION)
    target = payoff.put_target(
        F.col("next_price"), F.col("step"), sum(terms[1:], terms[0]),
        strike=OPTION["strike"], expiry=OPTION["expiry"], rate=RATE, steps=DAYS,
    )
    return rounded(path.select("user_id", "step", target.alias("target")))

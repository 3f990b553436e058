"""The feature build against a row-by-row reading of the definitions."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tipoff.limits import Limits
from tipoff.operators import snapshots, stack
from tipoff.plans import features as plan
from tipoff.schema import FEATURES, GAME, PLAY_LOG
from tipoff.sources import play_log

N = 4
CUTS = [720, 1440, 2160, float("inf")]


def generate(seed, games=14, plays=60):
    """Teams P, Q, R; game 0 is hot; plays tie on the clock; some sides never shoot."""
    rng = random.Random(seed)
    log, seq = [], 0
    for g in range(games):
        home, away = rng.sample(["P", "Q", "R"], 2)
        day = date(2018, 1, 1) + timedelta(days=g // 2 * rng.choice([1, 1, 3]))
        for _ in range(plays * (6 if g == 0 else 1)):
            seq += 1
            at_home = rng.random() < 0.5
            kind = rng.choice(["shot", "shot", "free", "none"])
            made = rng.choice(["make", "miss"])
            who = f"{home if at_home else away}{rng.randrange(3)}"
            quarter = rng.choice([1, 2, 3, 4, 4, 5])
            log.append(dict(
                HomeTeam=home, AwayTeam=away, Date=f"{day.day}/{day.month}/{day.year}", Quarter=quarter,
                SecLeft=rng.randrange(0, 300 if quarter == 5 else 720, 20),
                HomePlay="x" if at_home else None, GameType="playoff" if g == 5 else "regular",
                ShotOutcome=made if kind == "shot" else None,
                FreeThrowOutcome=made if kind == "free" else None,
                Shooter=who if kind == "shot" else None, FreeThrowShooter=who if kind == "free" else None,
                ShotType=rng.choice(["3-pt", "2-pt", None]), Season=2017 if g < 4 else 2018, PlaySeq=seq,
            ))
    return log


def by_hand(log):
    """Interval scores per player and game, replaying each game play by play."""
    games = defaultdict(list)
    for p in log:
        games[(p["HomeTeam"], p["AwayTeam"], p["Date"])].append(p)
    out = {}
    for key, plays in games.items():
        running, states = defaultdict(int), []

        def clock(p):
            if p["Quarter"] <= 4:
                return p["Quarter"] * 720 - p["SecLeft"]
            return 2160 + (p["Quarter"] - 4) * 300 - p["SecLeft"]

        for p in sorted(plays, key=lambda p: (clock(p), p["PlaySeq"])):
            shot, free = p["ShotOutcome"], p["FreeThrowOutcome"]
            if (shot is None and free is None) or p["GameType"] != "regular":
                continue
            team = key[0] if p["HomePlay"] else key[1]
            player = p["FreeThrowShooter"] if free else p["Shooter"]
            value = 1 if free else 2 if p["ShotType"] == "2-pt" else 3
            points = value if "make" in (shot, free) else 0
            for k in ("all", ("team", team), ("player", player)):
                running[k] += points
            states.append((clock(p), team, player, dict(running), running["all"] - running[("team", team)]))
        for player in {s[2] for s in states}:
            team = next(s[1] for s in states if s[2] == player)
            scores = []
            for cut in CUTS:
                seen = [s for s in states if s[0] <= cut]
                scores.append((
                    max([s[3][("player", player)] for s in seen if s[2] == player], default=0),
                    max([s[3]["all"] for s in seen], default=0),
                    max([s[3][("team", team)] for s in seen if s[1] == team], default=0),
                    max([s[4] for s in seen if s[1] == team], default=0),
                ))
            out[(player, *key)] = scores
    return out


def frame(spark, log):
    names = [*PLAY_LOG.fieldNames(), "Season", "PlaySeq"]
    kinds = [f.dataType.simpleString() for f in PLAY_LOG] + ["int", "long"]
    return spark.createDataFrame([tuple(p[c] for c in names) for p in log], ", ".join(
        f"{n} {k}" for n, k in zip(names, kinds)))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("large", [False, True])
def test_snapshots_match_a_replay(spark, tiny, seed, large):
    log = generate(seed)
    wide = snapshots.interval_snapshots(
        plan.prepare_plays(frame(spark, log)), N, limits=tiny if large else Limits()
    )
    got = {
        (r.Player, *(r[c] for c in GAME)): list(zip(
            r.CumulativePlayerPoints, r.CumulativeTotalPoints, r.CumulativeTeamPoints, r.CumulativeOpponentPoints))
        for r in wide.collect()
    }
    assert got == by_hand(log)


def test_running_points_match_between_paths(spark, tiny):
    plays = plan.prepare_plays(frame(spark, generate(4))).where("Counted")
    columns = ["PlaySeq", *[f"Cumulative{x}Points" for x in ("Player", "Total", "Team", "Opponent")]]
    assert rows(snapshots.running_points(plays), *columns) == rows(snapshots.running_points(plays, limits=tiny), *columns)


@pytest.mark.parametrize("large", [False, True])
def test_form_rest_and_numbers_match_pandas(spark, tiny, large):
    log = generate(7)
    limits = Limits(group_rows=5, block_rows=120, broadcast_rows=0, match_rows=10) if large else Limits()
    players = plan.player_games(
        plan.prepare_plays(frame(spark, log)), N, date_format="d/M/yyyy", limits=limits
    ).toPandas()
    hand = by_hand(log)
    games = pd.DataFrame([
        dict(zip(GAME, k), Date=pd.to_datetime(k[2], dayfirst=True)) for k in {(p["HomeTeam"], p["AwayTeam"], p["Date"]) for p in log}
    ]).sort_values(GAME).reset_index(drop=True)
    games["GameId"] = games.index
    ids = {tuple(g[c] for c in GAME): g.GameId for _, g in games.iterrows()}

    own = pd.DataFrame([dict(Player=k[0], **dict(zip(GAME, k[1:])), points=v[-1][0], team=v[-1][2], opp=v[-1][3])
                        for k, v in hand.items()]).merge(games, on=GAME)
    own = own.sort_values(["Date", *GAME])
    own["form"] = own.groupby("Player").points.transform(lambda x: x.ewm(span=5).mean())
    own = own.sort_values(GAME)
    own["number"] = own.groupby("Player").cumcount()

    totals = own.groupby([*GAME, "Date"], as_index=False)[["team", "opp"]].max().sort_values(["Date", *GAME])
    for side in ("HomeTeam", "AwayTeam"):
        for c in ("team", "opp"):
            totals[f"{side}_{c}"] = totals.groupby(side)[c].transform(lambda x: x.ewm(span=5).mean())

    sides = pd.concat([games.assign(Team=games.HomeTeam), games.assign(Team=games.AwayTeam)]).sort_values(["Date", *GAME])
    sides["rest"] = sides.groupby("Team").Date.diff().dt.days.fillna(0).clip(0, 4)

    joined = players.merge(own, on=["Player", *GAME], suffixes=("", "_hand"))
    joined = joined.merge(totals[[*GAME, *[f"{s}_{c}" for s in ("HomeTeam", "AwayTeam") for c in ("team", "opp")]]], on=GAME)
    joined = joined.merge(sides[[*GAME, "Team", "rest"]], on=[*GAME, "Team"])
    assert len(joined) == len(players) == len(hand)
    assert (joined.GameId == [ids[tuple(x)] for x in joined[GAME].itertuples(index=False)]).all()
    assert (joined.PlayerGameNumber == joined.number).all()
    assert (joined.TeamRest == joined.rest).all() and (joined.OpponentTeamRest == joined.rest).all()
    home = joined.Home == 1
    close = lambda a, b: (abs(a - b) < 1e-9).all()
    assert close(joined.RollingAvgPlayerPoints, joined.form)
    assert close(joined.RollingAverageTeamPoints, joined.HomeTeam_team.where(home, joined.AwayTeam_team))
    assert close(joined.RollingAverageOpposingTeamAllowedPoints, joined.AwayTeam_opp.where(home, joined.HomeTeam_opp))


def test_stacking_margins_and_order_invariance(spark):
    log = generate(3)
    build = lambda df: plan.build_features(df, N, min_games=1, season=None, date_format="d/M/yyyy")
    table = build(frame(spark, log))
    assert table.columns == FEATURES
    got = sorted(tuple(r) for r in table.collect())
    shuffled = list(log)
    random.Random(1).shuffle(shuffled)
    again = sorted(tuple(r) for r in build(frame(spark, shuffled).repartition(7)).collect())
    assert got == again
    per_game = defaultdict(list)
    for r in got:
        per_game[(r[FEATURES.index("Player")], r[FEATURES.index("GameId")])].append(dict(zip(FEATURES, r)))
    assert per_game
    for game_rows in per_game.values():
        assert [r["Interval"] for r in game_rows] == list(range(N + 1))
        for column in ("CumulativePlayerPointsInterval", "CumulativeTeamPointsInterval", "CumulativeOpponentPointsInterval"):
            values = [r[column] for r in game_rows]
            assert values[0] == 0 and values == sorted(values)
        for r, left in zip(game_rows, (48, 36, 24, 12, 0)):
            margin = r["CumulativeTeamPointsInterval"] - r["CumulativeOpponentPointsInterval"]
            assert r["ScoreMarginInterval"] == margin
            assert r["ScoreMarginxTimeRemainingInterval"] == abs(margin) * left
            assert r["ScoreMarginxTimeRemaining2Interval"] == abs(margin) * left**2


def test_another_statistic_names_its_columns(spark):
    log = generate(8)
    plays = plan.prepare_plays(frame(spark, log)).withColumn("Attempts", F.lit(1))
    players = plan.player_games(plays, N, "Attempts", date_format="d/M/yyyy")
    table = plan.feature_rows(players, N, "Attempts")
    assert table.columns == [c.replace("Points", "Attempts") for c in FEATURES]
    last = table.where(F.col("Interval") == N).agg(F.sum("CumulativePlayerAttemptsInterval")).first()[0]
    assert last == plays.where("Counted").count()


def test_golden_margins(spark):
    wide = spark.createDataFrame(
        [("p", [18, 33, 33, 38], [43, 75, 98, 98], [21, 58, 88, 88])],
        "Player string, CumulativePlayerPoints array<long>, CumulativeTeamPoints array<long>, CumulativeOpponentPoints array<long>",
    )
    got = stack.interval_features(stack.stack_intervals(wide, 4), 4).orderBy("Interval").collect()
    assert [(r.ScoreMarginInterval, r.ScoreMarginxTimeRemainingInterval, r.ScoreMarginxTimeRemaining2Interval)
            for r in got] == [(0, 0, 0), (22, 792, 28512), (17, 408, 9792), (10, 120, 1440), (10, 0, 0)]


def test_many_intervals_do_not_mix(spark):
    log = generate(5, games=2, plays=40)
    wide = snapshots.interval_snapshots(plan.prepare_plays(frame(spark, log)), 12)
    got = stack.stack_intervals(wide, 12).where("Interval = 1").select("Player", "CumulativePlayerPointsInterval")
    assert sorted(r[1] for r in got.collect()) == sorted(r.CumulativePlayerPoints[0] for r in wide.collect())


def test_null_game_keys_are_dropped_and_null_shooters_still_score(spark):
    log = generate(6, games=3)
    broken = [dict(p, HomeTeam=None) if i % 50 == 0 else p for i, p in enumerate(log)]
    tables = snapshots.score_tables(plan.prepare_plays(frame(spark, broken)), N)
    named = {(p["HomeTeam"], p["AwayTeam"], p["Date"]) for p in broken if p["HomeTeam"]}
    assert set(map(tuple, tables.games.select(*GAME).collect())) == named
    assert tables.game_rows == len(named)
    nobody = [dict(p, Shooter=None, FreeThrowShooter=None) for p in log]
    whole = snapshots.score_tables(plan.prepare_plays(frame(spark, log)), N).games
    anonymous = snapshots.score_tables(plan.prepare_plays(frame(spark, nobody)), N).games
    columns = [*GAME, "HomeTeamPoints", "AwayTeamPoints", "HomeOpponentPoints", "AwayOpponentPoints"]
    assert rows(whole, *columns) == rows(anonymous, *columns)


def test_sequence_out_of_range_is_an_error(spark):
    log = [dict(p, PlaySeq=-1) for p in generate(1, games=1, plays=5)]
    with pytest.raises(Exception, match="play sequence"):
        snapshots.score_tables(plan.prepare_plays(frame(spark, log)), N)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_feature_table_roundtrip(spark, tmp_path, fmt):
    table = plan.build_features(frame(spark, generate(2)), N, min_games=2, season=2018, date_format="d/M/yyyy")
    path = str(tmp_path / "features")
    play_log.write_features(table, path, fmt)
    back = play_log.read_features(spark, path, fmt)
    assert back.columns == FEATURES
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def swings(seed, games=6, plays=60):
    """A raw log with a signed statistic, ties on the clock, and games where only one side shoots."""
    rng = random.Random(seed)
    found = []
    for g in range(games):
        for i in range(plays):
            home = None if g == 1 or rng.random() < 0.5 else "play"
            shot = rng.choice(["make", "miss", None])
            found.append((f"H{g % 2}", f"A{g % 3}", f"2024-01-{g + 1:02d}", rng.randrange(1, 6), rng.randrange(0, 700, 50), home,
                         "regular", shot, None, None if shot is None else f"p{rng.randrange(4)}", None, "2-pt", 2018, i, rng.randrange(-9, 8)))
    return found


SWING_LOG = (
    "HomeTeam string, AwayTeam string, Date string, Quarter int, SecLeft int, HomePlay string, GameType string, ShotOutcome string, "
    "FreeThrowOutcome string, Shooter string, FreeThrowShooter string, ShotType string, Season int, PlaySeq long, Swing int"
)


def test_a_side_without_plays_up_to_a_cut_has_no_total_of_0(spark):
    play = lambda seq, quarter, home, player, swing: (
        "H", "A", "2024-01-01", quarter, 0, home, "regular", "make", None, player, None, "2-pt", 2018, seq, swing)
    log = spark.createDataFrame([play(0, 1, "play", "h", -5), play(1, 2, "play", "h", 2), play(2, 4, None, "a", -4)], SWING_LOG)
    found = snapshots.interval_snapshots(plan.prepare_plays(log), 4, "Swing", running=True).collect()
    assert {r.Player for r in found} == {"h", "a"}
    assert all(r.CumulativeTotalSwing == [-5, -3, -3, -3] for r in found)
    assert {r.Player: r.CumulativeTeamSwing for r in found} == {"h": [-5, -3, -3, -3], "a": [0, 0, 0, -4]}


def replayed(log, at_cut):
    """Per player and game the four scores at each cut, play by play."""
    found = {}
    order = sorted((r for r in log if r[7]), key=lambda r: (_elapsed(r), r[13]))
    for game in {r[:3] for r in log}:
        totals, seen = {}, []
        for r in (r for r in order if r[:3] == game):
            side = 1 if r[5] else 0
            for key in (("p", r[9]), ("t", side), ("g",)):
                totals[key] = totals.get(key, 0) + r[14]
            seen.append((_elapsed(r), side, r[9], totals["p", r[9]], totals["t", side], totals["g",]))
        for player in {s[2] for s in seen}:
            own = next(s[1] for s in seen if s[2] == player)
            out = []
            for cut in (720, 1440, 2160, 10**9):
                upto = [s for s in seen if s[0] <= cut]
                pick = (lambda v: v[-1] if v else 0) if at_cut else (lambda v: max(v, default=0))
                p, t = pick([s[3] for s in upto if s[2] == player]), pick([s[4] for s in upto if s[1] == own])
                o = pick([s[5] for s in upto]) - t if at_cut else pick([s[5] - s[4] for s in upto if s[1] == own])
                out.append((p, t, o))
            found[(player, *game)] = out
    return found


def _elapsed(r):
    return 720 * r[3] - r[4] if r[3] <= 4 else 2160 + 300 * (r[3] - 4) - r[4]


def test_falling_statistics_through_the_build(spark, tiny):
    plays = swings(4)
    log = spark.createDataFrame(plays, SWING_LOG)
    for opponent_score in ("at_last_play", "at_cut"):
        want = replayed(plays, opponent_score == "at_cut")
        tables = []
        for limits in (Limits(), tiny):
            built = plan.build_features(
                log, 4, 0, None, "Swing", running=True, opponent_score=opponent_score, team_total="own", limits=limits
            ).collect()
            tables.append(sorted(map(str, built)))
            got = {}
            for r in built:
                if r.Interval:
                    key = (r.Player, r.Date, r.Interval)
                    got[key] = (r.CumulativePlayerSwingInterval, r.CumulativeTeamSwingInterval, r.CumulativeOpponentSwingInterval)
                    assert r.ScoreMarginInterval == got[key][1] - got[key][2]
            expected = {
                (k[0], date.fromisoformat(k[3]), i + 1): v for k, values in want.items() for i, v in enumerate(values)
            }
            assert got == expected
        assert tables[0] == tables[1]
    with pytest.raises(Exception, match="running=True"):
        plan.build_features(log, 4, 0, None, "Swing").collect()

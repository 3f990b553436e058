"""Inputs on which a shortcut would give a wrong answer without an error."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tests.conftest import TINY
from tipoff import queries, session
from tipoff.functions import network
from tipoff.limits import Limits
from tipoff.operators import plays as play_ops, snapshots
from tipoff.operators.form import ewm_mean, player_game_totals
from tipoff.operators.moments import gram_matrix
from tipoff.operators.ordered import framed, row_rank, running_sums
from tipoff.plans import fitted_q
from tipoff.schema import STATE
from tipoff.sources import play_log
from tipoff.sources.event_log import plays_from_events

FOLDER = "/root/testdata/sf0.001"
present = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")

TAIL = [1e20] + [0.0] * 123 + [1.0] * 5
GAPS = [None, 4.0, None, 1.0, 2.0, None, float("nan"), 7.0]


@pytest.mark.parametrize("values", [TAIL, GAPS])
@pytest.mark.parametrize("span", [1, 5, 50])
@pytest.mark.parametrize("limits,block,current", [(Limits(), None, True), (TINY, 5, False), (TINY, None, True)])
def test_weighted_mean_forgets_nothing(spark, values, span, limits, block, current):
    rows = [(k, i, v) for k in ("a", None) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k string, i int, v double")
    got = ewm_mean(frame, {"m": "v"}, ["k"], ["i"], span=span, include_current=current, limits=limits, block=block).toPandas()
    want = pd.Series(values, dtype=float).ewm(span=span).mean().shift(0 if current else 1)
    for mine in (got.k == "a", got.k.isna()):
        np.testing.assert_allclose(got[mine].sort_values("i").m.to_numpy(float), want, rtol=1e-9)


@pytest.mark.parametrize("limits", [Limits(), Limits(group_rows=30_000, block_rows=9_000)])
def test_weighted_mean_of_a_long_span(spark, limits):
    values = np.random.default_rng(1).random(100_000)
    frame = spark.createDataFrame(pd.DataFrame({"k": 1, "i": range(100_000), "v": values}))
    got = ewm_mean(frame, {"m": "v"}, ["k"], ["i"], span=1001, limits=limits).toPandas().sort_values("i").m
    np.testing.assert_allclose(got.to_numpy(), pd.Series(values).ewm(span=1001).mean(), rtol=1e-9)


def test_null_keys_are_split_like_any_other(spark):
    frame = spark.createDataFrame([(None, i) for i in range(90)] + [("a", i) for i in range(5)], "k string, i int")
    frame = frame.withColumn("one", F.lit(1))
    ranks = row_rank(frame, ["k"], ["i"], "r", limits=TINY).where("r <> i").count()
    sums = running_sums(frame, ["k"], ["i"], "one", {"s": []}, limits=TINY).where("s <> i + 1").count()
    back = framed(frame, ["k"], ["i"], {"b": lambda w: F.lag("i").over(w)}, before=1, limits=TINY)
    assert ranks == sums == back.where("b <> i - 1").count() == 0 and back.count() == 95


def game(rows, value="Points"):
    """(home?, elapsed, seq, player, points) of one game as prepared plays."""
    return [("H", "A", "1/1/2024", h, "H" if h else "A", t, s, p, v, True, 2018) for h, t, s, p, v in rows]


def prepared(spark, rows, kind="int"):
    schema = f"HomeTeam string, AwayTeam string, DateKey string, Home int, Team string, TimeElapsed int, PlaySeq long, Player string, Points {kind}, Counted boolean, Season int"
    return spark.createDataFrame(game(rows), schema)


def test_fractions_are_kept(spark):
    got = snapshots.interval_snapshots(prepared(spark, [(1, 10 * i, i, "p", 0.5) for i in range(6)], "double"), 2).first()
    assert got.CumulativePlayerPoints == [3.0, 3.0]


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_a_falling_statistic_counts_at_its_highest(spark, limits):
    rows = [(1, 10, 0, "p", 5), (1, 20, 1, "p", 5), (1, 30, 2, "p", 5), (1, 40, 3, "p", -10), (0, 50, 4, "q", -3)]
    frame = prepared(spark, rows)
    got = {r.Player: r for r in snapshots.interval_snapshots(frame, 2, running=True, limits=limits).collect()}
    assert got["p"].CumulativePlayerPoints == [15, 15] and got["p"].CumulativeTotalPoints == [15, 15]
    assert got["q"].CumulativePlayerPoints == [-3, -3] and got["q"].CumulativeOpponentPoints == [5, 5]
    totals = player_game_totals(frame, running=True, limits=limits)
    assert {r.Player: r.CumulativePlayerPoints for r in totals.collect()} == {"p": 15, "q": -3}
    for wrong in (snapshots.interval_snapshots, player_game_totals):
        with pytest.raises(Exception, match="negative Points"):
            wrong(frame).collect()


def test_late_clocks_keep_their_order(spark):
    rows = [(0, 39_000, 1, "q", 2), (1, 40_000, 2, "p", 3), (0, 41_000, 3, "q", 2)]
    got = {r.Player: r for r in snapshots.interval_snapshots(prepared(spark, rows), 1).collect()}
    assert got["p"].CumulativeOpponentPoints == [2]
    assert [r.CumulativeOpponentPoints for r in snapshots.interval_snapshots(prepared(spark, rows), 1, game_seconds=50_000).where("Player = 'p'").collect()] == [[2]]


@pytest.mark.parametrize("clock", [-1, 70_000])
def test_impossible_clocks_are_errors(spark, clock):
    with pytest.raises(Exception, match="game clock outside"):
        snapshots.interval_snapshots(prepared(spark, [(1, clock, 0, "p", 1)]), 2).collect()


@pytest.mark.parametrize("running", [False, True])
def test_plays_without_a_clock_are_in_no_interval(spark, running):
    rows = [(1, 10, 0, "p", 1), (1, None, 1, "p", 5), (0, None, 2, "q", 7), (0, 20, 3, "q", 2)]
    got = {r.Player: r for r in snapshots.interval_snapshots(prepared(spark, rows), 1, running=running).collect()}
    if not running:
        assert got["p"].CumulativePlayerPoints == [1] and got["q"].CumulativeTeamPoints == [2]
    assert set(got) == {"p", "q"}


@pytest.mark.parametrize("opponent", ["reference", "true"])
def test_rest_of_a_one_sided_game(spark, opponent):
    sides = [1] * 200 + [0]
    raw = spark.createDataFrame(
        [("H", "A", "1/1/2024", i, "x" if h else None) for i, h in enumerate(sides)],
        "HomeTeam string, AwayTeam string, DateKey string, PlaySeq long, HomePlay string",
    )
    plays = play_ops.attribute_plays(raw, opponent=opponent)
    counts = play_ops.team_plays(plays)
    faced = {r.Team: (r.Plays, r.Faced) for r in counts.collect()}
    assert faced == ({"H": (200, 200), "A": (1, 1)} if opponent == "reference" else {"H": (200, 1), "A": (1, 200)})
    rest = counts.withColumn("TeamRest", F.when(F.col("Team") == "H", 1).otherwise(2))
    plain = play_ops.attach_rest(plays, rest, row_bound=2)
    salted = play_ops.attach_rest(plays, rest, limits=TINY)
    key = lambda df: sorted(map(tuple, df.select("PlaySeq", "TeamRest", "OpponentTeamRest").collect()))
    assert key(plain) == key(salted)
    spread = salted._jdf.queryExecution().optimizedPlan().toString()
    assert spread.count("_salt") > 2


def test_matrix_sums_take_whole_rows_only(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), (None, [5.0, 5.0]), ([0.0, 1.0], None)]
    frame = spark.createDataFrame(rows, "l array<double>, r array<double>")
    cells = {(r.i, r.j): r.value for r in gram_matrix(frame, "l", "r", (2, 2)).collect()}
    assert cells == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.0}
    for bad in ([1.0], [1.0, 2.0, 3.0], [None, 1.0]):
        with pytest.raises(PythonException, match="vector"):
            gram_matrix(spark.createDataFrame([(bad, [1.0, 2.0])], frame.schema), "l", "r", (2, 2)).collect()


def test_missing_state_has_no_score(spark):
    rows = spark.createDataFrame([tuple([1.0] * 13), (None, *[1.0] * 12)], ", ".join(f"{c} double" for c in STATE))
    scores = [r.res for r in fitted_q.score_network(rows, network.initial_parameters(13, 1)).collect()]
    assert scores[0] is not None and scores[1] is None


def test_logs_must_have_their_columns(spark, tmp_path):
    (tmp_path / "log.csv").write_text("HomeTeam,AwayTeam,Quarter\nA,B,1\n")
    with pytest.raises(ValueError, match="SecLeft"):
        play_log.read_plays(spark, str(tmp_path / "log.csv"))


def test_unreadable_numbers_are_counted(spark, tmp_path):
    (tmp_path / "log.csv").write_text("HomeTeam,Quarter,SecLeft\nA,1,x\nB,two,700\nC,,3\n")
    found = {r["column"]: (r.filled, r.unreadable) for r in play_log.unreadable(spark, str(tmp_path / "log.csv")).collect()}
    assert found == {"Quarter": (2, 1), "SecLeft": (3, 1)}


def test_a_scope_removes_what_was_written_in_it(spark):
    frame = spark.range(3)
    outside = session.materialize(frame)
    with session.intermediates(spark):
        inside = session.materialize(frame)
        path = inside.inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path) and outside.count() == 3


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return "file:/tmp/x"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return None

    with pytest.raises(ValueError, match="one machine"):
        session.shared_folder(Session())


def test_jacobian_by_differences():
    random = np.random.default_rng(0)
    theta, x = network.initial_parameters(4, 1), random.random((3, 4))
    q, slopes = network.jacobian(theta, x)
    for k in range(0, len(theta), 7):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        numeric = (network.forward(theta + step, x) - network.forward(theta - step, x)) / 2e-6
        np.testing.assert_allclose(slopes[:, k], numeric, atol=1e-7)
    np.testing.assert_allclose(q, network.forward(theta, x))


@present
def test_every_event_is_a_play(spark):
    for sf in ("0.001", "0.01", "0.1"):
        events = queries.table(spark, f"/root/testdata/sf{sf}", "events")
        plays = plays_from_events(events)
        assert plays.count() == events.count()
        dates = sorted(r[0] for r in play_ops.parse_dates(play_ops.key_dates(plays), "d/M/yyyy").select("Date").distinct().collect())
        assert {1, 2, 3, 5} == {(b - a).days for a, b in zip(dates, dates[1:])}


@present
def test_training_runs_until_it_settles(spark):
    end = queries.QUERIES["fitted_q_converged"](spark, "/root/testdata/sf0.01").first()
    short = queries.QUERIES["fitted_q_loss"](spark, "/root/testdata/sf0.01").orderBy(F.desc("step")).first()
    assert end.converged and end.last_loss < 0.9 * short.loss


def test_a_log_is_read_once_and_bad_rows_kept_aside(spark, tmp_path):
    from tipoff.schema import PLAY_LOG

    names = ["Extra", *reversed(PLAY_LOG.fieldNames())]
    good = {"HomeTeam": "H", "AwayTeam": "A", "Date": "2018-01-01", "Quarter": "2", "SecLeft": "30", "GameType": "regular"}
    line = lambda **cells: ",".join({**good, **cells}.get(c, "") for c in names)
    lines = [",".join(names), line(), line(Quarter="two"), line(Quarter="", SecLeft="3e"), line(Quarter="x", SecLeft="y"), line(), "short,line", line() + ",more"]
    path = tmp_path / "log.csv"
    path.write_text("\n".join(lines) + "\n")
    found = play_log.read_checked(spark, str(path))
    counts = {r["column"]: (r.filled, r.unreadable) for r in found.counts.collect()}
    assert counts["Quarter"][1] == 2 and counts["SecLeft"][1] == 2 and counts["line"] == (7, 2)
    assert (found.rows, found.rejected_rows) == (7, 5)
    assert [(r.HomeTeam, r.Quarter, r.SecLeft) for r in found.plays.collect()] == [("H", 2, 30)] * 2
    bad = sorted(tuple((b["column"], b.content) for b in r.bad) for r in found.rejected.collect() if r.bad[0]["column"] != "line")
    assert bad == [(("Quarter", "two"),), (("Quarter", "x"), ("SecLeft", "y")), (("SecLeft", "3e"),)]
    assert {b.content for r in found.rejected.collect() for b in r.bad if b["column"] == "line"} >= {"short,line"}
    loose = play_log.read_checked(spark, str(path), drop=False)
    assert loose.plays.count() == 7 and loose.plays.columns == PLAY_LOG.fieldNames()
    # Plays and rejected rows come from what the one pass wrote, not from the log.
    assert not any(f.endswith("log.csv") for f in found.plays.inputFiles() + found.rejected.inputFiles())
    with pytest.raises(ValueError, match="no column"):
        play_log.read_checked(spark, str(path), PLAY_LOG.add("Missing", "string"))


@pytest.mark.parametrize("span", [1])
def test_last_values_are_carried_over_blocks(spark, span):
    """A hot key in blocks of four, with long gaps: no window holds the key."""
    import random

    random.seed(6)
    values = [None if random.random() < 0.8 else random.random() for _ in range(300)] + [None] * 90 + [5.0]
    frame = spark.createDataFrame([("hot", i, v) for i, v in enumerate(values)] + [("b", 0, 1.0), ("c", 0, None)], "k string, i int, v double")
    for current in (True, False):
        made = ewm_mean(frame, {"m": "v"}, ["k"], ["i"], span=span, include_current=current, limits=TINY, block=4)
        got = made.where("k = 'hot'").orderBy("i").toPandas().m.to_numpy(float)
        want = pd.Series(values, dtype=float).ewm(span=span).mean().shift(0 if current else 1)
        np.testing.assert_allclose(got, want)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_block" in line for line in windows if "last(" in line)

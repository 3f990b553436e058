"""The shape of the plans: what is shuffled, broadcast and read."""

import re

import pytest
from pyspark.sql import functions as F

from tipoff.functions.clock import interval_cuts
from tipoff.limits import Limits
from tipoff.operators import snapshots
from tipoff.operators.pairs import bellman_pairs
from tipoff.plans import features as plan
from tipoff.schema import GAME
from tipoff.session import materialize
from tipoff.sources.event_log import DATE_FORMAT, plays_from_events

FOLDER = "/root/testdata/sf0.001"
NEEDED = {"event_id", "ts", "user_id", "event_type", "props"}


@pytest.fixture(scope="module")
def plays(spark):
    return plan.prepare_plays(plays_from_events(spark.read.parquet(f"{FOLDER}/events.parquet")))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange (?:hash|range)partitioning|Exchange SinglePartition", physical(df))


def scanned(df):
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", physical(df)).group(1)))


def test_summary_folds_plays_before_its_only_shuffle(plays):
    summary = snapshots.play_summary(plays, interval_cuts(4))
    text = physical(summary)
    assert len(shuffles(summary)) == 1 and "SortAggregate" not in text
    assert text.index("Exchange") < text.index("partial_sum")  # printed top down: partial sums come first
    assert scanned(summary) == NEEDED


def test_opponent_pass_broadcasts_only_a_bounded_table(plays):
    summary = materialize(snapshots.play_summary(plays, interval_cuts(4)))
    games = snapshots.game_summary(summary, 4)
    small = snapshots.opponent_snapshots(plays, games, 4, row_bound=100)
    assert "BroadcastHashJoin" in physical(small)
    large = snapshots.opponent_snapshots(plays, games, 4, limits=Limits(broadcast_rows=0, match_rows=10))
    assert re.search(r"SortMergeJoin \[HomeTeam#\d+, AwayTeam#\d+, DateKey#\d+, _salt#\d+\]", unforced(large))


def unforced(df):
    """The plan with automatic broadcasts off, as for tables over the size limit."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return physical(df.select("*"))
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_running_totals_share_one_shuffle(plays):
    columns = ["PlaySeq", *GAME, "Team", "Player", "TimeElapsed", "Points"]
    totals = snapshots.running_points(plays.where("Counted").select(columns))
    assert len(shuffles(totals)) == 1


def test_pairs_need_no_window_and_no_shuffle(plays):
    players = plan.eligible_games(plan.player_games(plays, 4, date_format=DATE_FORMAT), 1, None)
    rows, paired = plan.feature_rows(players, 4), plan.feature_rows(players, 4, paired=True)
    assert len(shuffles(paired)) == len(shuffles(rows))
    assert physical(paired).count("Window [") == physical(rows).count("Window [")
    # Rows without the vectors are paired by a window, which reuses the shuffle by player.
    assert len(shuffles(bellman_pairs(rows))) == len(shuffles(rows))


def test_lookup_reaches_the_scan(spark, plays):
    summary = materialize(snapshots.play_summary(plays, interval_cuts(4)))
    found = snapshots.player_snapshots(summary, 4).where(F.col("Player") == "3")
    assert "EqualTo(Player,3)" in physical(found)

from pyspark.sql import functions as F

from tests.conftest import rows
from tipoff.functions import clock
from tipoff.operators import plays as ops
from tipoff.schema import PLAY_LOG
from tipoff.sources import play_log


def make(spark, **columns):
    defaults = dict(
        HomeTeam="H", AwayTeam="A", Date="2018-01-01", Quarter=1, SecLeft=720, HomePlay=None,
        GameType="regular", ShotOutcome=None, FreeThrowOutcome=None, Shooter=None,
        FreeThrowShooter=None, ShotType=None,
    )
    count = max(len(v) for v in columns.values())
    data = [tuple(columns[c][i] if c in columns else defaults[c] for c in defaults) for i in range(count)]
    return spark.createDataFrame(data, PLAY_LOG)


def test_clock(spark):
    plays = make(spark, Quarter=[0, 1, 4, 4, 5, 5, 6], SecLeft=[720, 700, 720, 0, 300, 0, 300])
    got = ops.add_game_clock(plays).collect()
    assert [r.TimeElapsed for r in got] == [0, 20, 2160, 2880, 2160, 2460, 2460]
    assert [r.TimeRemaining for r in got] == [2880, 2860, 720, 0, 300, 0, 300]
    after = ops.add_game_clock(plays, overtime="after_regulation").collect()
    assert [r.TimeElapsed for r in after] == [0, 20, 2160, 2880, 2880, 3180, 3180]


def test_interval_cuts():
    assert clock.interval_cuts(4) == [720, 1440, 2160, None]
    assert clock.minutes_left(4) == [48, 36, 24, 12, 0]
    assert clock.interval_cuts(2) == [1440, None]


def test_attribution(spark):
    plays = make(spark, HomePlay=["dunk", None])
    assert rows(ops.attribute_plays(plays), "Home", "Team", "Opponent") == [(0, "A", "A"), (1, "H", "H")]
    assert rows(ops.attribute_plays(plays, opponent="true"), "Home", "Opponent") == [(0, "H"), (1, "A")]


def test_points(spark):
    plays = make(
        spark,
        ShotOutcome=["make", "make", "make", "miss", None, None, "make", "miss", None],
        FreeThrowOutcome=[None, None, None, None, "make", "miss", "miss", "make", None],
        ShotType=["3-pt jump", "2-pt", None, "3-pt", None, "3-pt", "2-pt", None, "2-pt"],
        Shooter=["s"] * 9,
        FreeThrowShooter=["f"] * 9,
    )
    got = ops.scoring_events(plays).collect()
    # A missing shot type is worth three; with both outcomes a made shot counts as one point.
    assert [r.PotentialPoints for r in got] == [3, 2, 3, 3, 1, 1, 1, 1]
    assert [r.Points for r in got] == [3, 2, 3, 0, 1, 0, 1, 1]
    assert [r.Player for r in got] == ["s"] * 4 + ["f"] * 4


def test_dates_keep_their_text_and_bad_ones_are_null(spark):
    plays = make(spark, Date=["January 2 2018", "soon"])
    dated = ops.parse_dates(ops.key_dates(plays), "MMMM d yyyy")
    got = [(r.DateKey, str(r.Date)) for r in dated.collect()]
    assert got == [("January 2 2018", "2018-01-02"), ("soon", "None")]


def test_csv_logs_are_matched_by_name_tagged_and_numbered(spark, tmp_path):
    names = PLAY_LOG.fieldNames()
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    line = dict(HomeTeam="H", AwayTeam="A", Date="2018-01-01", Quarter="2", SecLeft="30", GameType="regular")
    order = ["Extra", *reversed(names)]
    first.write_text(",".join(order) + "\n" + ",".join(line.get(c, "") for c in order) + "\n")
    second.write_text(",".join(names) + "\n" + (",".join(line.get(c, "") for c in names) + "\n") * 2)
    log = play_log.load_plays(spark, {2017: str(first), 2018: str(second)})
    got = log.orderBy("Season").collect()
    assert [r.Season for r in got] == [2017, 2018, 2018]
    assert {(r.HomeTeam, r.Quarter, r.SecLeft, r.HomePlay) for r in got} == {("H", 2, 30, None)}
    assert all(0 <= r.PlaySeq < 2**48 for r in got) and got[0].PlaySeq != got[1].PlaySeq


def test_csv_log_with_bad_numbers(spark, tmp_path):
    path = tmp_path / "c.csv"
    names = PLAY_LOG.fieldNames()
    cells = {"HomeTeam": "H", "Quarter": "two", "SecLeft": "30"}
    path.write_text(",".join(reversed(names)) + "\n" + ",".join(cells.get(c, "") for c in reversed(names)) + "\n")
    got = play_log.read_plays(spark, str(path)).first()
    assert (got.HomeTeam, got.Quarter, got.SecLeft, got.ShotType) == ("H", None, 30, None)


def test_union_fills_missing_columns(spark):
    one, two = make(spark, Quarter=[1]), make(spark, Quarter=[2])
    both = play_log.union_seasons({2017: one.drop("ShotType"), 2018: two.withColumn("ShotType", F.lit("2-pt"))})
    assert sorted(tuple(r) for r in both.select("Season", "ShotType").collect()) == [(2017, None), (2018, "2-pt")]

"""Logs with dates in several formats, and with dates that nothing reads."""

import pytest

from tests.test_plays import make
from tipoff.operators import dates, plays as ops
from tipoff.plans import features as plan
from tipoff.session import new_path
from tests.test_features import SWING_LOG, swings

TEXTS = ["2024-01-05", "7/1/2024", "31/1/2024", "2/1/2024", "8 Jan 2024", "soon", "", None]
FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy-MM-dd", "d MMM yyyy"]


def test_coverage_counts_rows_by_weight(spark):
    frame = spark.createDataFrame([(t, i + 1) for i, t in enumerate(TEXTS)], "DateKey string, Plays int")
    got = [tuple(r) for r in dates.date_coverage(frame, FORMATS, weight="Plays").orderBy("position").collect()]
    assert got == [
        ("M/d/yyyy", 0, 2 + 4, 0, 2 + 4), ("d/M/yyyy", 1, 2 + 3 + 4, 3, 2 + 4), ("yyyy-MM-dd", 2, 1, 1, 0),
        ("d MMM yyyy", 3, 5, 5, 0), (None, 4, 6 + 7, 6 + 7, 0),
    ]
    assert dates.preferred(dates.date_coverage(frame, FORMATS, weight="Plays"))[:2] == ["d/M/yyyy", "M/d/yyyy"]
    assert dates.preferred(dates.date_coverage(frame.limit(0), FORMATS)) == FORMATS


def test_first_preferred_format_reads(spark):
    frame = make(spark, Date=TEXTS)
    keyed = ops.key_dates(frame)
    read = {r.DateKey: str(r.Date) for r in dates.read_dates(keyed, ["d/M/yyyy", "M/d/yyyy", "yyyy-MM-dd", "d MMM yyyy"], bad="null").collect()}
    assert read == {"2024-01-05": "2024-01-05", "7/1/2024": "2024-01-07", "31/1/2024": "2024-01-31", "2/1/2024": "2024-01-02",
                    "8 Jan 2024": "2024-01-08", "soon": "None", "": "None", None: "None"}
    with pytest.raises(Exception, match="unreadable date"):
        dates.read_dates(keyed, FORMATS).collect()
    with pytest.raises(ValueError):
        dates.Dates(bad="ignore")


def test_the_build_stops_at_or_sets_aside_a_bad_date(spark):
    rows = swings(8)
    rows = [(*r[:2], {"2024-01-02": "2/1/2024", "2024-01-04": "tbd"}.get(r[2], r[2]), *r[3:]) for r in rows]
    log = spark.createDataFrame(rows, SWING_LOG)
    build = lambda date_format: plan.build_features(log, 2, 0, None, date_format=date_format)
    with pytest.raises(Exception, match="unreadable date"):
        build("yyyy-MM-dd").collect()
    formats = ("d/M/yyyy", "yyyy-MM-dd")
    with pytest.raises(Exception, match="unreadable date tbd"):
        build(list(formats)).collect()
    aside = new_path(spark)
    kept = build(dates.Dates(formats, "quarantine", aside)).collect()
    left_out = [tuple(r) for r in spark.read.parquet(aside).collect()]
    assert left_out == [(*rows[3 * 60][:2], "tbd", 60)]
    clean = spark.createDataFrame([(*r[:2], "2024-01-02" if r[2] == "2/1/2024" else r[2], *r[3:]) for r in rows if r[2] != "tbd"], SWING_LOG)
    want = plan.build_features(clean, 2, 0, None).collect()
    bare = lambda found: sorted(str([v for c, v in r.asDict().items() if c != "GameId"]) for r in found)
    assert bare(kept) == bare(want) and {str(r.Date) for r in kept} >= {"2024-01-02"}
    loose = build(dates.Dates(formats, "null")).collect()
    assert any(r.Date is None for r in loose)

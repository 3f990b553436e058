"""Sorted tables: order of files, ranges, lookups that open few files."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from tipoff.session import new_path
from tipoff.sources import play_log, sorted_table as st

SCHEMA = T.StructType([
    T.StructField("Player", T.StringType()), T.StructField("GameId", T.LongType()),
    T.StructField("Interval", T.IntegerType()), T.StructField("Score", T.DoubleType()),
])


def table(spark, seed=1, players=40):
    """One player has a third of all rows; some keys are null."""
    random.seed(seed)
    rows = [(f"p{random.randrange(players)}", g, i, random.random()) for g in range(200) for i in range(5)]
    rows += [("p7", 1000 + g, i, 0.0) for g in range(100) for i in range(5)]
    rows += [(None, g, 0, 1.0) for g in range(20)] + [("pß", None, 0, 2.0), ("", 5, 0, 3.0)]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(7)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0) for v in r[:3]))


def files_of(df):
    return len(df.inputFiles())


def test_files_in_name_order_are_the_sorted_table(spark):
    rows, frame = table(spark)
    path = new_path(spark)
    covered = st.write_sorted(frame, path, file_rows=100).orderBy("file").collect()
    assert sum(r["rows"] for r in covered) == len(rows) and len(covered) > 8
    for before, after in zip(covered, covered[1:]):
        last, first = (ordered([tuple(s) + (0,)])[0] for s in (before["last"], after["first"]))
        assert ordered([first, last])[0] == last
    placed = st.file_positions(spark, path, SCHEMA).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(len(rows)))
    assert [(r.Player, r.GameId, r.Interval) for r in placed] == [r[:3] for r in ordered(rows)]


def test_text_files_are_in_order_too(spark):
    rows, frame = table(spark, seed=2)
    frame = frame.where("Player != '' AND GameId IS NOT NULL")
    path = new_path(spark)
    st.write_sorted(frame, path, file_rows=150, fmt="csv")
    lines = []
    for file in sorted(spark.read.text(path).inputFiles()):
        lines += [tuple(r) for r in spark.read.csv(file, header=True, schema=SCHEMA).select("Player", "GameId", "Interval").collect()]
    want = ordered([r for r in rows if r[0] and r[1] is not None])
    assert lines == [r[:3] for r in want]
    assert st.lookup(spark, path, SCHEMA, fmt="csv", Player="p3").count() == sum(r[0] == "p3" for r in rows)


def test_lookup_opens_only_files_that_can_match(spark):
    rows, frame = table(spark, seed=3)
    path = new_path(spark)
    n = st.write_sorted(frame, path, file_rows=100).count()
    for wanted in ({"Player": "p7", "GameId": 1042}, {"Player": "p3"}, {"Player": "p7"}, {"GameId": 17}, {"Player": None},
                   {"Player": "p3", "Interval": 2}, {"Player": "nobody"}, {"Player": "pß"}, {}):
        found = st.lookup(spark, path, SCHEMA, **wanted)
        at = {"Player": 0, "GameId": 1, "Interval": 2}
        want = [r for r in rows if all(r[at[c]] == v for c, v in wanted.items())]
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)), wanted
    point = st.lookup(spark, path, SCHEMA, Player="p7", GameId=1042)
    assert files_of(point) == 1 < n
    plan = point._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(Player), IsNotNull(GameId), EqualTo(Player,p7), EqualTo(GameId,1042)]" in plan
    assert files_of(st.lookup(spark, path, SCHEMA, Player="p7")) < n


def test_empty_tables_and_ordered_sinks(spark):
    path = new_path(spark)
    st.write_sorted(spark.createDataFrame([], SCHEMA), path)
    assert st.lookup(spark, path, SCHEMA, Player="p1").count() == 0
    _, frame = table(spark)
    path = new_path(spark)
    play_log.write_scores(frame, path, "parquet", ordered=True)
    assert st.read_sorted(spark, path, SCHEMA).count() == frame.count()


def test_feature_lookup_reads_one_of_many_files(spark):
    from tipoff.queries import FILE_ROWS, player_game_lookup, sorted_features
    from tipoff.schema import FEATURE_TABLE

    folder = "/root/testdata/sf0.01"
    path = sorted_features(spark, folder)
    total = files_of(st.read_sorted(spark, path, FEATURE_TABLE))
    one = player_game_lookup(spark, folder)
    assert total == -(-st.read_sorted(spark, path, FEATURE_TABLE).count() // FILE_ROWS) > 3
    assert files_of(one) <= 2
    assert one.agg(F.countDistinct("Player", "GameId")).first()[0] == 1

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tipoff.limits import Limits
from tipoff.operators.form import ewm_mean
from tipoff.operators.joins import join_dimension
from tipoff.operators.keys import first_non_null, group_ordinal
from tipoff.operators.ordered import framed, hot_groups, row_rank, running_sums, with_position


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 'hot' holds a third of the rows; times tie, seq is unique."""
    rng = random.Random(3)
    keys = ["hot"] * 60 + [f"k{rng.randrange(12)}" for _ in range(120)]
    data = [(k, rng.randrange(25), i, rng.randrange(5)) for i, k in enumerate(keys)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, t int, seq long, v int").repartition(5)


@pytest.fixture(scope="module")
def expected(skewed):
    return skewed.toPandas().sort_values(["key", "t", "seq"]).reset_index(drop=True)


def test_hot_groups_finds_only_large_keys(skewed, tiny):
    found, n, rows = hot_groups(skewed, ["key"], tiny)
    assert [r.key for r in found.collect()] == ["hot"] and n == 1 and rows > tiny.group_rows
    assert hot_groups(skewed, ["key"], Limits(group_rows=60)) is None


@pytest.mark.parametrize("small", [True, False])
def test_running_sums(skewed, expected, tiny, small):
    groups = skewed.withColumn("g", F.when(F.col("seq") % 4 != 0, F.col("seq") % 4))
    levels = {"s": [], "by_group": ["g"]}
    got = running_sums(groups, ["key"], ["t", "seq"], "v", levels, limits=tiny if small else Limits())
    groups_of = expected.assign(g=expected.seq % 4)
    want = expected.assign(
        s=expected.groupby("key").v.cumsum(), by_group=groups_of.groupby(["key", "g"]).v.cumsum()
    )
    names = ["key", "seq", "s", "by_group"]
    assert rows(got, *names) == sorted(want[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("small", [True, False])
def test_row_rank(skewed, expected, tiny, small):
    got = row_rank(skewed, ["key"], ["t", "seq"], "n", limits=tiny if small else Limits())
    want = expected.assign(n=expected.groupby("key").cumcount())
    assert rows(got, "key", "seq", "n") == sorted(want[["key", "seq", "n"]].itertuples(index=False, name=None))


@pytest.mark.parametrize("reach", [1, 3])
def test_framed_sees_across_block_borders(skewed, expected, tiny, reach):
    columns = {
        "back": lambda w: F.lag("v", reach, -1).over(w),
        "ahead": lambda w: F.lead("v", reach, -1).over(w),
    }
    got = framed(skewed, ["key"], ["t", "seq"], columns, before=reach, after=reach, limits=tiny)
    by = expected.groupby("key").v
    want = expected.assign(back=by.shift(reach, fill_value=-1), ahead=by.shift(-reach, fill_value=-1))
    names = ["key", "seq", "back", "ahead"]
    assert rows(got, *names) == sorted(want[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("current", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_ewm_matches_pandas(skewed, expected, tiny, small, current):
    limits = Limits(group_rows=20, block_rows=30) if small else Limits()
    got = ewm_mean(
        skewed, {"e": "v"}, ["key"], ["t", "seq"], include_current=current, limits=limits
    ).toPandas().sort_values(["key", "t", "seq"])
    mean = expected.groupby("key").v.transform(lambda x: x.ewm(span=5).mean())
    if not current:
        mean = mean.groupby(expected.key).shift()
    np.testing.assert_allclose(got.e.to_numpy(dtype=float), mean.to_numpy(), rtol=1e-12)


def test_ewm_of_a_long_series(spark):
    values = np.random.default_rng(1).poisson(12, 2400)
    frame = spark.createDataFrame([(1, i, int(v)) for i, v in enumerate(values)], "k int, t int, v int")
    got = ewm_mean(frame, {"e": "v"}, ["k"], ["t"]).orderBy("t").toPandas().e
    np.testing.assert_allclose(got, pd.Series(values).ewm(span=5).mean(), rtol=1e-12)


def test_position_is_the_sorted_index(spark):
    values = random.Random(1).sample(range(10_000), 500)
    got = with_position(spark.createDataFrame([(v,) for v in values], "v int").repartition(6), ["v"], "p")
    assert rows(got, "p", "v") == list(enumerate(sorted(values)))


@pytest.mark.parametrize("bound", [None, 10])
def test_group_ordinal_ranks_text_and_skips_nulls(spark, bound):
    data = [("B", "2/1"), ("A", "10/1"), ("A", "2/1"), ("A", "10/1"), (None, "1/1")]
    got = group_ordinal(spark.createDataFrame(data, "h string, d string"), ["h", "d"], "id", row_bound=bound)
    assert rows(got, "h", "d", "id") == [("A", "10/1", 0), ("A", "2/1", 1), ("B", "2/1", 2)]


def test_first_non_null_is_per_column(spark):
    data = [(1, 3, "c", None), (1, 1, None, 7), (1, 2, "b", 8), (2, 1, None, None)]
    frame = spark.createDataFrame(data, "k int, o int, a string, b int")
    got = first_non_null(frame, ["k"], ["a", "b"], F.col("o"))
    assert sorted(got.collect()) == [(1, "b", 7), (2, None, None)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast_join(spark, skewed, tiny, how):
    counts = skewed.groupBy("key").agg(F.count("*").alias("n"))
    dim = counts.where("key <> 'k3'").withColumn("label", F.upper("key"))
    plain = join_dimension(skewed, dim, ["key"], rows="n", spread="seq", how=how)
    salted = join_dimension(skewed, dim, ["key"], rows="n", spread="seq", how=how, limits=tiny)
    assert "_salt" in salted._jdf.queryExecution().toString()
    key = lambda r: (r.seq, str(r.label))
    columns = ["key", "seq", "v", "label"]
    assert sorted(plain.select(*columns).collect(), key=key) == sorted(salted.select(*columns).collect(), key=key)

"""Exact search against brute force."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipoff.llm import topk
from tipoff.llm.topk import Search, exact_top_k, segment_statistics

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q in sorted(good):
        if q % 5:
            continue
        asking = max(good[q])
        score = {c: max(sum(a * b for a, b in zip(asking, v)) for v in vs) for c, vs in good.items() if c != q}
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, c, s) for n, (c, s) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_against_brute_force(spark, block):
    random = np.random.default_rng(5)
    rows = [(i, random.standard_normal(24).astype("f4").tolist(), 0) for i in range(200)]
    rows += [(200 + i, rows[3][1], 0) for i in range(10)]  # ties
    rows += [(i, rows[i][1], 0) for i in (0, 3, 5)]  # repeated rows
    rows += [(300, None, 0), (305, [float("nan")] * 24, 0), (310, [1.0, None], 0), (None, [1.0] * 24, 0), (315, [float("inf")] * 24, 0)]
    rows += [(320, [], 0), (325, [0.5, -2.0], 0), (330, [0.25] * 30, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).repartition(3)
    got = exact_top_k(frame, F.col("vec_id") % 5 == 0, k=5, block=block)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5)


def test_bounds_hold_and_tighten():
    random = np.random.default_rng(2)
    a, b = random.standard_normal((30, 50)).cumsum(1), random.standard_normal((40, 50)).cumsum(1)
    exact = a @ b.T
    before = np.inf
    for s in (1, 4, 16):
        bound = segment_statistics(a, s) @ segment_statistics(b, s).T
        assert (bound >= exact - 1e-9).all()
        assert bound.sum() < before
        before = bound.sum()


def test_pruning_spares_exact_scores():
    random = np.random.default_rng(2)
    rows = np.floor(256 * random.standard_normal((2000, 32)).cumsum(1))
    search = Search(np.arange(10), rows[:10], 5)
    for at in range(0, 2000, 256):
        search.add(np.arange(at, min(2000, at + 256)), rows[at:at + 256])
    assert search.compared < 0.5 * 10 * 2000


def test_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert exact_top_k(one, F.col("vec_id") % 5 == 0).count() == 0
    assert exact_top_k(one.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_large_components_are_exact_or_an_error(spark):
    random = np.random.default_rng(8)
    rows = [(i, (random.standard_normal(8) * 10.0 ** random.integers(0, 7)).astype("f4").tolist(), 0) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact_top_k(frame, F.col("vec_id") % 5 == 0, k=5)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5)
    beyond = spark.createDataFrame([(0, [1e18, 1.0], 0), (1, [1e18, 2.0], 0), (2, [1.0, 1.0], 0)], SCHEMA)
    with pytest.raises(Exception, match="does not fit a long"):
        exact_top_k(beyond, F.col("vec_id") % 5 == 0).collect()


def test_sums_at_the_edge_of_doubles():
    from tipoff.llm.topk import scores

    a, b = np.array([[2.0**31, 1.0, -3.0]]), np.array([[2.0**31, 1.0, 1.0]])
    assert scores(a, b).tolist() == [2**62 - 2]


def test_memory_of_a_full_block_does_not_depend_on_pruning():
    random = np.random.default_rng(3)
    rows = np.floor(256 * random.standard_normal((4608, 64)))  # without structure: the bounds leave every pair
    search = Search(np.arange(4096), rows[:4096], 5)
    tracemalloc.start()
    for at in (0, 4096):
        search.add(np.arange(at, at + 512), rows[at:at + 512])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


@pytest.mark.parametrize("times", [1, 1e4, 1e6])  # products exact in floats, in doubles, in Python's numbers
@pytest.mark.parametrize("walk", [False, True])  # whole tiles, single pairs
@pytest.mark.parametrize("few", [1 / 64, 2.0])
def test_tiles_of_any_size_find_the_same(monkeypatch, times, walk, few):
    monkeypatch.setattr(topk, "PAIRS", 150)
    monkeypatch.setattr(topk, "NUMBERS", 100)
    monkeypatch.setattr(topk, "FEW", few)
    random = np.random.default_rng(4)
    rows = random.standard_normal((300, 24))
    rows = np.floor(40 * (rows.cumsum(1) if walk else rows)) * times
    rows[40:80] = rows[7]  # ties
    rows[90] = 0
    ids = random.permutation(np.arange(300))
    ids[200:220] = ids[100:120]  # other rows of an id
    search = Search(ids[:20], rows[:20], 4)
    for at in range(0, 300, 70):
        search.add(ids[at:at + 70], rows[at:at + 70])
    want = []
    for q in range(20):
        score = {}
        for i, row in zip(ids.tolist(), rows.tolist()):
            if i != ids[q]:
                s = sum(int(a) * int(b) for a, b in zip(rows[q].tolist(), row))
                score[i] = max(s, score.get(i, s))
        want += [(q, s, i) for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:4]]
    assert list(map(tuple, search.result().tolist())) == want


def test_wide_queries_go_out_in_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD", 64)
    random = np.random.default_rng(6)
    rows = [(i, random.standard_normal(30).astype("f4").tolist(), 0) for i in range(25)]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, k=3)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 3)

"""Targets, rates and copies of the mix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import ODD, SCHEMA, documents, empty
from tipoff.limits import Limits
from tipoff.llm.mixing import LIMITS, mix, mixed_documents, word_count

TINY = Limits(group_rows=20, block_rows=7, broadcast_rows=0, match_rows=10)


def corpus(spark, seed=3, n=900, copies=0):
    random = np.random.default_rng(seed)
    sources = ["x", "é", "a", None, "Z", "tiny", "empty"]
    rows = []
    for i in range(n):
        source = sources[min(int(random.exponential(1.2)), 4)] if i > 3 else "tiny"
        rows.append((i, " ".join(["w"] * int(random.lognormal(4, 1))), None, source, None))
    rows += [(n + i, "same size " * 20, None, "x", None) for i in range(copies)]
    rows += [(10_000 + i, None, None, "empty", None) for i in range(3)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def slow_targets(sizes):
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = sum(weight[s] for s in order if s not in full)
        level = (goal - sum(2 * sizes[s] for s in full)) / open_ if open_ else 0
        more = {s for s in order if s not in full and weight[s] * level >= 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def test_words(spark):
    texts = [t for t in ODD]
    frame = documents(spark, texts)
    for r in frame.select("text", word_count(F.col("text")).alias("n")).collect():
        text = r.text or ""
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        assert r.n == len([w for w in text.split(" ") if w])


@pytest.mark.parametrize("limits,copies", [(LIMITS, 0), (TINY, 300)])
def test_targets_are_met(spark, limits, copies):
    rows, docs = corpus(spark, copies=copies)
    got = mix(docs.withColumn("target", F.lit("clash")), limits=limits).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    targets = slow_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    by_rate = dict.fromkeys(sizes, 0.0)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s]
        assert abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2 and abs(r.copies - r.rate) < 1
        taken[s] += r.taken
        by_rate[s] += r.rate * r.size
    largest = {s: max(size[i] for i in size if source[i] == s) for s in sizes}
    for s in sizes:
        assert abs(by_rate[s] - targets[s]) <= 1e-4 * targets[s] + 1
        assert abs(taken[s] - targets[s]) <= largest[s]
    # Rates are tilted by size alone within a source, monotonously.
    for s in sizes:
        at = sorted((r.size, r.rate) for r in got if source[r.doc_id] == s and r.size)
        steps = np.diff([x[1] for x in at])
        assert (steps >= -1e-9).all() or (steps <= 1e-9).all()


def test_reruns_and_partitions_agree(spark):
    _, docs = corpus(spark, copies=40)
    first = sorted(map(tuple, mix(docs).collect()), key=str)
    again = sorted(map(tuple, mix(docs.repartition(7), limits=TINY).collect()), key=str)
    assert first == again


def test_documents_as_often_as_taken(spark):
    docs = documents(spark, [t for t in ODD if t is None or len(t) < 5000], extra=True).unionByName(
        corpus(spark, n=60)[1], allowMissingColumns=True
    )
    want = {(r.doc_id, r.src): r.copies * r.rows for r in mix(docs).collect()}
    for limits in (LIMITS, TINY):
        out = mixed_documents(docs, limits=limits)
        assert out.columns == docs.columns
        got = {}
        for r in out.collect():
            key = (r.doc_id, "b" if r.source is None else "a" + r.source)
            got[key] = got.get(key, 0) + 1
        assert got == {k: n for k, n in want.items() if n}


def test_nothing(spark):
    assert mix(empty(spark)).count() == 0
    assert mixed_documents(empty(spark)).count() == 0

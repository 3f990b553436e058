"""Phrase counts and scores against plain counting, at every plan; odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.texts import ODD, SCHEMA, clashing, documents, empty
from tipoff.llm import collocations as cl


def slow_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", piece) if w] for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def slow(rows, at_least, longest=5, first=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for words in slow_words(text):
            totals["und" if lang is None else lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts["und" if lang is None else lang, tuple(words[i:i + size])] += 1
    frequent = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= at_least}
    dropped = set()
    for (lang, words), n in frequent.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if n >= counts[lang, words[i:i + size]]:
                    dropped.add((lang, words[i:i + size]))
    found = {}
    for (lang, words), a in frequent.items():
        if (lang, words) in dropped:
            continue
        n = totals[lang]
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * n // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r, n))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n, -s)
        for lang, own in found.items() for i, (s, a, p, l, r, n) in enumerate(sorted(own)[:first])
    )


def corpus(seed, docs=120):
    random.seed(seed)
    words = ["the", "The", "of", "and", "new", "york", "city", "san", "francisco", "été", "x-1", "日本"] + [f"w{i}" for i in range(40)]
    weights = [9, 2, 8, 6, 3, 3, 2, 2, 2, 2, 1, 2] + [1] * 40
    fixed = ["new york city", "of the", "the city of san francisco", "ha ha ha ha ha ha", "no\tone  knows"]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(random.randrange(60)):
            parts.append(random.choice(fixed) if random.random() < 0.25 else random.choices(words, weights)[0])
            if random.random() < 0.15:
                parts.append(random.choice([".", ",", " ; ", "!", "\n", "\r\n", "..."]))
        rows.append((random.choice(["en", "en", "fr", None, ""]), " ".join(parts)))
    return rows + [(None, None), ("en", ""), ("fr", " . , "), ("zz", "alone")]


def frame(spark, rows):
    made = spark.createDataFrame([(i, t, lang, None, None) for i, (lang, t) in enumerate(rows)], SCHEMA)
    return clashing(made, ("name", "l", "r", "n", "phrase", "rank", "total", "a.b", "Lang"))


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("options", [{}, {"head": 5}, {"head": 1, "first": 7}, {"longest": 3, "at_least": 2}])
def test_phrases_by_plain_counting(spark, options):
    rows = corpus(len(options))
    bound = {"at_least": 10} | options
    plain = {k: v for k, v in bound.items() if k != "head"}
    assert collected(cl.collocations(frame(spark, rows), **bound)) == slow(rows, **plain)


def test_names_that_meet_are_noticed(spark):
    """Under 14-bit names the first salts make words or phrases meet; results stay the same or it is an error, never wrong."""
    rows = corpus(5, docs=40)
    want = slow(rows, 10)
    tries = []
    for bits in (64, 12, 4):
        try:
            tries.append(collected(cl.collocations(frame(spark, rows), at_least=10, mask=(1 << bits) - 1)))
        except RuntimeError:
            continue
    assert tries and all(t == want for t in tries)


def test_odd_rows(spark):
    rows = [(None, t) for t in ODD] * 2
    got = collected(cl.collocations(documents(spark, ODD, extra=True), at_least=4))
    assert got == slow(rows, 4)
    assert cl.collocations(empty(spark)).count() == 0
    assert cl.collocations(documents(spark, [None, "", "one"])).count() == 0


def test_tiles_count_like_a_plain_table():
    random.seed(2)
    rng = np.random.default_rng(2)
    left, right = rng.zipf(1.3, 30_000) % 300, rng.zipf(1.3, 30_000) % 70
    for tile, dense in ((16, 100), (64, 1), (1024, 1 << 40), (7, 1)):
        a, b, n = cl.count_pairs(left, right, tile, dense)
        assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(left.tolist(), right.tolist()))
    a, b, n = cl.count_names(left.astype(np.uint64), right.astype(np.uint64))
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(left.tolist(), right.tolist()))
    assert [len(c) for c in cl.count_pairs(left[:0], right[:0])] == [0, 0, 0]


def test_products_beyond_64_bits(spark):
    """floor(1000 a n / (l r)) where every product passes 64 bits."""
    big = 10**16 + 7
    known = spark.createDataFrame(
        [("en", "a", 3 * 10**15 + 1, 1), ("en", "b", 2 * 10**15 + 3, 1), ("en", "a b", 10**15 + 9, 2)], "lang string, phrase string, n long, words int"
    )
    totals = spark.createDataFrame([("en", big - 1)], "lang string, total long")
    row = cl._scored(known, totals, 10).first()
    assert row.score == 1000 * (10**15 + 9) * (big - 1) // ((3 * 10**15 + 1) * (2 * 10**15 + 3))


def test_packed_pairs_come_back():
    rng = np.random.default_rng(3)
    for across, buckets in ((1, 1), (1, 7), (300, 12), (7, 300), (65536, 51)):
        keys = np.unique(rng.integers(0, 65536 * across, 5000))
        stripes, back = cl.Stripes(across, buckets), []
        for bucket, place, rows in stripes.dealt(keys):
            assert (np.diff(place) > 0).all()
            steps = cl._from_planes(cl._planes(np.diff(place, prepend=0))).astype(np.int64)
            assert np.array_equal(stripes.keys(bucket, np.cumsum(steps)), keys[rows])
            back.append(keys[rows])
        assert np.array_equal(np.sort(np.concatenate(back)), keys)


def test_pairs_are_shuffled_in_few_packed_rows(spark, monkeypatch):
    """A row for each bucket of a task, not one for each pair; what a task holds changes no result."""
    rows = corpus(6)
    made, real = [], cl._pair_counts
    monkeypatch.setattr(cl, "_pair_counts", lambda *a: made.append(real(*a)) or made[-1])
    whole = collected(cl.collocations(frame(spark, rows), at_least=10))
    pairs = {(lang, *p) for lang, t in rows for w in slow_words(t) for p in zip(w, w[1:])}
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made[0].count() <= 2 * buckets * made[0].rdd.getNumPartitions() < len(pairs)
    monkeypatch.setattr(cl, "HELD", 1)
    monkeypatch.setattr(cl, "ROWS", 2)
    assert collected(cl.collocations(frame(spark, rows), at_least=10, head=5)) == whole == slow(rows, 10)


def test_counting_pairs_holds_little_at_a_time():
    """3 million words, nearly all pairs different: what a task holds stays far below all of them."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(4)
    names = np.arange(1, 60_001, dtype=np.uint64)
    task = cl._pair_counts(
        SimpleNamespace(mapInArrow=lambda count, schema: count), [SimpleNamespace(value=(names, None, 0))], 2, 0, (1 << 64) - 1, 50
    )

    def batches():
        for _ in range(30):
            codes = rng.integers(1, 60_001, 100_000).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([codes]), pa.array([b""])], ["codes", "tails"])

    tracemalloc.start()
    try:
        counted = sum(int(cl._from_planes(n).sum()) for batch in task(batches()) for n in batch.column(3).to_pylist())
        assert counted > 2_900_000 and tracemalloc.get_traced_memory()[1] < 96 << 20
    finally:
        tracemalloc.stop()

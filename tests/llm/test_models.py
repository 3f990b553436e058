"""Held-out accuracy and defined results of the fitted operators."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import FOLDER, ODD, documents, empty, present
from tipoff.llm.boosting import fit_forest
from tipoff.llm.common import held_out, table
from tipoff.llm.labelled import lowest, training_labels
from tipoff.llm.quality_gam import FEATURES, features, fit, keep_good, score_quality
from tipoff.llm.toxicity import Automaton, Matcher, choose_terms, context_weight, score_toxicity

BIG = FOLDER.replace("0.001", "0.01")
LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distances():
    terms = [("stupid", False), ("idiot", False), ("disgusting", False), ("scum", False), ("lowei", True), ("lostra", True)]
    automaton = Automaton(terms)
    random = np.random.default_rng(1)
    letters = "abcdegilmnorstupw"
    words = [t for t, _ in terms] + ["lostrabc", "lostrebc", "loweiung", "lowfi", "stupd", "sstupid", "stuipd", "tupid"]
    for t, _ in terms:
        for _ in range(400):
            w = list(t)
            for _ in range(random.integers(0, 4)):
                at, c = random.integers(0, len(w) + 1), random.choice(list(letters))
                kind = random.integers(0, 3)
                w = w[:at] + [c] + w[at + (kind == 0):] if kind < 2 else w[:at] + w[at + 1:]
                w = w or ["x"]
            words.append("".join(w) + ("ung" if random.random() < 0.2 else ""))
    for w in words:
        best = []
        for n, (t, stem) in enumerate(terms):
            k = (0 if len(t) < 6 else 1) if stem else (0 if len(t) < 5 else 1 if len(t) < 8 else 2)
            d = min(distance(w[:i], t) for i in range(len(w) + 1)) if stem else distance(w, t)
            if d <= k and w[0] == t[0]:
                best.append((d, n))
        got = automaton.match(w)
        # A first letter that is right by coincidence may still need it to be the one edited.
        if got is None:
            assert not best or all(first_kept(w, *terms[n]) > d for d, n in best)
        else:
            assert (got[1], got[0]) in [(first_kept(w, *terms[n]), n) for d, n in best]


def first_kept(w, term, stem):
    if w[0] != term[0]:
        return 99
    if stem:
        return min(distance(w[1:i], term[1:]) for i in range(1, len(w) + 1))
    return distance(w[1:], term[1:])


def test_every_place_may_be_misspelt():
    terms = [("stupid", False), ("idiot", False), ("disgusting", False), ("scum", False), ("lowei", True), ("lostra", True)]
    automaton = Automaton(terms, first_kept=False)
    random = np.random.default_rng(2)
    words = ["tupid", "ztupid", "xstupid", "diot", "isgustin", "cum", "ostrabc", "xlostrabc"]
    for t, _ in terms:
        for _ in range(400):
            w = list(t)
            for _ in range(random.integers(0, 4)):
                at, c = random.integers(0, len(w) + 1), random.choice(list("acdegilmnostrupx"))
                kind = random.integers(0, 3)
                w = w[:at] + [c] + w[at + (kind == 0):] if kind < 2 else w[:at] + w[at + 1:]
            words.append("".join(w or ["x"]) + ("ung" if random.random() < 0.2 else ""))
    for w in words:
        near = []
        for n, (t, stem) in enumerate(terms):
            d = min(distance(w[:i], t) for i in range(len(w) + 1)) if stem else distance(w, t)
            if d <= automaton.allowed[n]:
                near.append((d, n))
        got = automaton.match(w)
        assert (got and (got[1], got[0])) == min(near, default=None), w


@pytest.mark.parametrize("word,errors", [
    ("moron", 0), ("m0ron", 0), ("st*pid", 0), ("id1ot", 0), ("1diot", 0), ("$tupid", 0), ("stup!d", 0), ("s**m", 0), ("sc*m", 0), ("st#pid", 0),
    ("tupid", 1), ("ztupid", 1), ("m6ron", 1), ("mor0m", 1), ("stupid99", 0), ("2stupid", 0), ("moron@mail.com", 0), ("stupid!idiot", 0),
    ("****", None), ("s***", None), ("slum", None), ("m66on", None), ("12345", None), ("st*y", None),
])
def test_disguised_words_match(word, errors):
    matcher = Matcher([(t, False, 1.0) for t in ("stupid", "idiot", "moron", "scum")])
    exact, one, two, *_ = matcher.features(f"that {word} ran off")
    assert (exact > 0, one > 0, two > 0) == tuple(errors == k for k in range(3))


def test_plain_pieces_still_match():
    matcher = Matcher([("stupid", False, 1.0), ("idiot", False, 1.0)])
    plain = matcher.features("that stupid idiot ran off")
    for text in ("that stupid!idiot ran off", "that stupid7idiot ran off", "that stupid@idiot ran off"):
        assert matcher.features(text) == plain


def test_forgotten_states_change_nothing(monkeypatch):
    terms = [("stupid", False), ("disgusting", False), ("lostra", True)]
    words = ["stupid", "ztupid", "disgustinng", "isgustin", "lostrabc", "xostra", "st*pid", "d1sgust", "plain"] * 2
    plain = [Automaton(terms, first_kept=False).match(w) for w in words]
    monkeypatch.setattr("tipoff.llm.toxicity.STATES", 3)
    small = Automaton(terms, first_kept=False)
    assert [small.match(w) for w in words] == plain


@pytest.mark.parametrize("text", ["a" + "*" * 200_000 + "b", "@$" * 100_000, "a1" * 100_000, "a*" * 100_000, "a" + "#" * 200_000])
def test_long_runs_of_symbols_take_linear_time(text):
    assert Matcher([("stupid", False, 1.0)]).features(text) == [0.0] * 6


def test_quotations_count_less():
    plain = context_weight("they are all ", " and more")
    assert plain == 1.0
    assert context_weight('he said "you ', ' man" loudly') < context_weight('and "the ', ' man" again') < plain
    assert context_weight("and you ", " there") > plain
    assert context_weight('"yes" and ', " there") == plain


def test_stems_and_words_do_not_double():
    rows = [("lowei", True, 9, 0, 50.0, 1.0), ("lowe", True, 9, 0, 50.0, 1.0), ("loweiung", False, 5, 0, 30.0, 1.0), ("scum", False, 4, 0, 20.0, 0.9)]
    assert choose_terms(rows) == [("lowei", True, 1.0), ("scum", False, 0.9)]


def test_additive_model_finds_an_interaction():
    random = np.random.default_rng(0)
    x = random.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert fit(x, np.ones(4000)).score(x).min() > 0.99


def test_forest_is_calibrated():
    random = np.random.default_rng(0)
    x = random.random((6000, 3))
    y = (random.random(6000) < np.where(x[:, 0] > 0.6, 0.9, 0.2)).astype(float)
    p = fit_forest(x, y).score(x)
    assert abs(p[x[:, 0] > 0.7].mean() - 0.9) < 0.05 and abs(p[x[:, 0] < 0.5].mean() - 0.2) < 0.05
    assert fit_forest(x, np.zeros(6000)) is None


def test_features_of_odd_texts():
    for t in ODD:
        found = features(t or "")
        assert len(found) == len(FEATURES) and np.isfinite(found).all()


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_every_row_has_a_score(spark, score):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(ODD))] + [(1, 1, 1), (None, 1, 0), (2, None, None)], LABELS)
    docs = documents(spark, extra=True)
    for known in (labels, labels.limit(0), labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})):
        got = score(docs, known).collect()
        assert sorted(r.doc_id for r in got) == sorted(i // 2 for i in range(2 * len(ODD)))
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if score is score_quality else 0.5)) for r in got)
    assert score(empty(spark), labels).count() == 0


def test_rejects_go_and_columns_stay(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], LABELS)
    docs = documents(spark, extra=True)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert keep_good(docs, labels.withColumn("quality", F.lit(0))).count() == 0


@pytest.mark.skipif(not present, reason="driver tables not present")
@pytest.mark.parametrize("score,target,least", [(score_quality, "quality", 0.95), (score_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, score, target, least):
    labels = table(spark, BIG, "labels")
    rows = score(table(spark, BIG, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[target] for r in rows]) >= least
    # Labels of the held-out fold must not matter.
    turned = labels.withColumn(target, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(target)).otherwise(F.col(target)))
    again = score(table(spark, BIG, "documents"), turned)
    first = {r.doc_id: r.score for r in rows}
    for r in again.collect():
        if r.doc_id in first:
            assert abs(r.score - first[r.doc_id]) < 1e-9


@pytest.mark.parametrize("sample", [3, 50, 5000])
def test_sample_is_the_first_by_hash(spark, sample):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    labels = labels.union(labels.limit(500)).union(spark.createDataFrame([(None, 1)], "doc_id long, quality long"))
    got = sorted(tuple(r) for r in training_labels(labels, "quality", sample=sample).collect())
    plain = labels.where("doc_id is not null").where(~held_out(F.col("doc_id"))).distinct()
    assert got == sorted(tuple(r) for r in plain.orderBy(F.xxhash64("doc_id")).limit(sample).collect())


def test_bound_keeps_most_rows_away(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    assert 100 <= hashes.where(F.col("h") <= lowest(hashes, 100)).count() <= 1000
    same = spark.range(1000).select(F.lit(2**62).alias("h"))
    assert same.where(F.col("h") <= lowest(same, 10)).count() == 1000
    assert lowest(same.limit(0), 10) == 2**63 - 1

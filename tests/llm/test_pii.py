"""Base spans against the patterns as given, and what the method adds."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import LONG, ODD, SCHEMA, documents, empty
from tipoff.llm import boosting, pii
from tipoff.llm.pii import base_spans, candidates, fits, personal_data, redact

# The patterns as given; slow on long runs, so used on short texts only.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def slow(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and checksum(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


SAMPLES = [
    "a.b@c.de and x@y@z.com @no.com é@ü.de", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (499) 555-6503 then +49 30 1234567890123456 and +1+22 33445566", "4111111111111111" * 3, "a@b.c.d.e-f..g", "1..2.3.4.5",
    "00000.0.0.0 1.2.3.000255", "+0-------1 +12345678( ", "5500 0000 0000 0004 ",
]


def test_base_spans_by_the_patterns():
    random.seed(3)
    texts = SAMPLES + ["".join(random.choices("01259.@+- ()aZ", k=60)) for _ in range(3000)]
    for t in texts:
        assert base_spans(t) == slow(t), t
        assert set(base_spans(t)) <= set(candidates(t, base_spans(t))) or any(b - a > 80 for _, a, b in base_spans(t))


@pytest.mark.parametrize("run", ["1" * 100_000, "a" * 100_000, "1." * 50_000, "+1" + " " * 100_000, "@" * 50_000, "1 " * 50_000, "a@" * 40_000])
def test_long_runs_take_linear_time(run):
    candidates(run, base_spans(run))


def test_rows(spark):
    texts = [*ODD[:10], *SAMPLES, LONG[:50_000]]
    got = personal_data(documents(spark, texts, extra=True), keep_text=True).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        want = slow(texts[r.doc_id] or "")
        kinds = ["email", "ip", "card", "phone"]
        spelt = ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(spelt.encode()).hexdigest()
        assert set(filter(None, spelt.split(","))) <= set(r.spans.split(","))
        assert (r.redacted is None) == (texts[r.doc_id] is None)


def test_other_forms_are_added_by_their_looks(spark):
    random.seed(5)
    number = lambda: f"({random.randint(200, 999)}) {random.randint(200, 999)}-{random.randint(1000, 9999)}"
    texts = [f"please call +1 {number()} or write now" for _ in range(300)]
    texts += [f"order {random.randint(10**7, 10**9)} of 12.5.2020 10:30 at {random.randint(10**6, 10**7)}" for _ in range(300)]
    texts += [f"please call 1 {number()} or write now" for _ in range(4)]
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].n_phone == 1 and not got[i].n_added for i in range(300))
    assert not any(got[i].n_added for i in range(300, 600))
    assert all(got[i].n_phone == 0 and got[i].spans.startswith("phone:") for i in range(600, 604))


OTHER = {
    "phone": ("please call {b} or write now", ["+1 ({0}) {1}-{2}"], ["({0}) {1}-{2}", "1 ({0}) {1}-{2}"]),
    "email": ("my mail is {b} or so", ["ab{0}@mail{1}.example.com"], ["ab{0} [at] mail{1}.example.com", "ab{0}(at)mail{1}.example.com"]),
    "ip": ("the server {b} is down", ["1{2:.1}.2{0:.1}.1{1:.2}.77"], ["1{2:.1}-2{0:.1}-1{1:.2}-77", "1{2:.1}:2{0:.1}:1{1:.2}:77"]),
    "card": ("charged to {b} again", ["4{0}{1}{2}{0}0"], ["37{0}{1}{2}{0}", "4{0}.{1}1.{2}.{0}0"]),
}


def of_kind(kind, form):
    while True:
        body = form.format(*(str(random.randint(*r)) for r in ((200, 499), (200, 999), (1000, 9999))))
        if kind != "card":
            return body
        plain = re.sub("[^0-9]", "", body)
        size = 15 if plain.startswith("37") else 16
        plain = (plain + "11")[:size - 1]
        plain += next(c for c in "0123456789" if checksum(plain + c))
        return ".".join(plain[i:i + 4] for i in range(0, 16, 4)) if "." in body else plain


@pytest.mark.parametrize("kind", list(OTHER))
@pytest.mark.parametrize("share", [0.3, 0.7])
@pytest.mark.parametrize("others", [True, False])
def test_forms_the_base_misses_are_added_however_frequent(spark, kind, share, others):
    random.seed(8)
    around, base, missed = OTHER[kind]
    texts = [around.format(b=of_kind(kind, random.choice(missed if i < 400 * share else base))) for i in range(400)]
    if others:
        texts += [f"order {random.randint(10**7, 10**9)} of 12.5.2020 10:30 at {random.randint(10**6, 10**7)}" for _ in range(200)]
        texts += [f"part {random.randint(10**15, 10**16 - 1) // 10 * 10 + 3} v 1.2.999.4 for 5 @ 12.50" for _ in range(200)]
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    got = sorted(personal_data(spark.createDataFrame(rows, SCHEMA)).collect())
    assert not any(r.n_added for r in got[int(400 * share):])
    found = [r for r in got[:int(400 * share)] if r.n_added == 1 and r.spans.startswith(f"{kind}:")]
    assert len(found) == int(400 * share)


def test_rare_kinds_keep_their_own_sample(spark):
    random.seed(9)
    around, base, _ = OTHER["email"]
    texts = [around.format(b=of_kind("email", base[0])) for _ in range(40)]
    texts += [around.format(b=of_kind("email", "ab{0} [at] mail{1}.example.com")) for _ in range(5)]
    texts += [f"part {random.randint(10**15, 10**16 - 1)} of {random.randint(10**15, 10**16 - 1)} or" for _ in range(3000)]
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    got = sorted(personal_data(spark.createDataFrame(rows, SCHEMA), sample=100).collect())
    assert [r.n_added for r in got[40:45]] == [1] * 5 and not any(r.n_added for r in [*got[:40], *got[45:]])


def test_long_base_spans_do_not_hide_other_candidates(spark):
    random.seed(10)
    around, base, missed = OTHER["phone"]
    texts = [around.format(b=of_kind("phone", base[0])) for _ in range(100)]
    long = "+4" + " " * 45 + "99" + " " * 45 + "55565"
    texts += [f"{long} and {long} then " + around.format(b=of_kind("phone", missed[0]))]
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    last = max(personal_data(spark.createDataFrame(rows, SCHEMA)).collect())
    assert (last.n_phone, last.n_added) == (2, 1)


NUMBERS = [
    "ISBN 978-3-16-148410-0 of", "on 12.05.2020 10 or", "from 1990-2000 on", "of 10 000 000 people", "pi is 3.14159265 so", "id 1234567890 ends",
    "costs $1234 5678 90 or", "v 1, 2, 3, 4 or", "at 10:30:15:20 on", "a 1-2-3-4 b", "me @ home. Then", "5 @ 12.50 each", "ms 1700000000000 now",
]


@pytest.mark.parametrize("text", NUMBERS)
def test_numbers_that_are_no_personal_data(text):
    assert not any(fits(text, s) for s in candidates(text, []))


def test_all_candidates_are_learned_from(spark, monkeypatch):
    """More than any bound there was: every candidate is in a cell, and passes by Spark fit what passes on the driver fit."""
    n, rows = 45_000, pii.N_FEATURES
    x = F.array(*[((F.col("id") * (k + 3)) % (5 + k)).cast("float") for k in range(rows)])
    role = ((F.col("id") % 5 + F.col("id") % 7) > 4).cast("int")
    found = spark.range(n, numPartitions=3).select(
        "id", F.array(*[F.lit(v) for v in (3, 0, 9)]).alias("spans"), x.alias("x"), F.array(role).alias("roles"))
    seen = []

    def fit(cells, count, edges):
        monkeypatch.setattr(boosting, "CELLS", 4000)
        spread = boosting.fit_forests(cells, count, edges, rounds=2)
        monkeypatch.setattr(boosting, "CELLS", 10**9)
        here = boosting.fit_forests(cells, count, edges, rounds=2)
        seen.append((cells.agg(F.sum("n")).first()[0], spread, here))
        return here

    monkeypatch.setattr(pii, "fit_forests", fit)
    selector = pii._learn(found, None)
    total, spread, here = seen[0]
    assert total == n + len(pii.decoys()[1])
    at = np.array(found.select("x").limit(200).toArrow().column(0).to_pylist())
    assert here[3] is not None and np.allclose(here[3].score(at), spread[3].score(at), rtol=1e-9)
    assert 3 not in selector.thresholds or selector.thresholds[3] >= pii.LEAST


def test_cells_fit_what_their_rows_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (4000, 5)).astype(float)
    y = (x[:, 0] + x[:, 1] > rng.normal(5, 1, 4000)).astype(float)
    held = np.arange(4000) % 5 == 4
    edges = [boosting.edges_of(*np.unique(c, return_counts=True)) for c in x[~held].T]
    bins = boosting.binned(x, edges).astype(np.uint8)
    rows = [(0, int(a), bool(h), b.tobytes()) for a, h, b in zip(y, held, bins)]
    cells = spark.createDataFrame(rows, "kind int, y int, held boolean, bins binary").groupBy("kind", "y", "held", "bins").agg(F.count("*").alias("n"))
    want, (got,) = boosting.fit_forest(x, y), boosting.fit_forests(cells, 4000, [edges])
    assert np.allclose(want.score(x), got.score(x), atol=1e-6)
    scores, truth = got.score(x[held]), y[held]
    good = [s for s in np.unique(scores) if truth[scores >= s].mean() >= 0.9]
    assert boosting.thresholds(cells, 4000, [got], 90) == {0: min(good)}
    assert boosting.thresholds(cells, 4000, [None], 90) == {}


def test_redaction_takes_overlaps_once():
    assert redact("ab cdef gh", [(0, 3, 7), (3, 5, 9)]) == "ab [email]h"


def test_nothing(spark):
    assert personal_data(empty(spark)).count() == 0

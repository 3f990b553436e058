"""Line deduplication and quality rules against brute force."""

from collections import Counter, defaultdict

import pytest

from tests.llm.texts import ODD, documents, empty
from tipoff.limits import Limits
from tipoff.llm.line_dedup import drop_boilerplate
from tipoff.llm.quality_rules import quality_rules
from tipoff.llm.site_lines import LIMITS

TINY = Limits(group_rows=20, block_rows=7, broadcast_rows=0, match_rows=3)
BLANK = " \t\n\x0b\x0c\r"
FOOT = "  Imprint and contact of the site 2024 "
PAGES = [
    *ODD, *[f"Title {i} alone\n{FOOT}\nbody of page number {i} with a few more words to read" for i in range(30)],
    *["copied body of a page\nin two lines"] * 20, FOOT, f"{FOOT}\n\n{FOOT}", "one two three four five " * 3,
    "a b c d e f a b c d e", "x y z " * 4 + "tail",
]


def words(text):
    for c in BLANK:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def pages_of(texts, sources):
    found = defaultdict(set)
    for i, t in enumerate(texts):
        found[sources[i % len(sources)]].add(t or "")
    return found


@pytest.mark.parametrize("limits", [LIMITS, TINY])
def test_boilerplate(spark, limits):
    sources = ("a", None, "b")
    site_pages = pages_of(PAGES, sources)
    on = {s: Counter(line for p in pages for line in {x.strip(BLANK) for x in p.split("\n")}) for s, pages in site_pages.items()}
    frequent = {s: {x for x, n in c.items() if x and n >= 5 and n > 0.01 * len(site_pages[s])} for s, c in on.items()}
    want = []
    for i, t in enumerate(PAGES):
        gone = frequent[sources[i % 3]]
        lines = (t or "").split("\n")
        kept = None if t is None else "\n".join(x for x in lines if x.strip(BLANK) not in gone)
        n = sum(1 for x in lines if x.strip(BLANK))
        want += [(i, kept, n, sum(x.strip(BLANK) in gone for x in lines))] * 2
    docs = documents(spark, PAGES, sources, extra=True)
    got = drop_boilerplate(docs, counts=("lines_seen", "lines_gone"), limits=limits)
    assert got.columns == [*docs.columns, "lines_seen", "lines_gone"]
    key = lambda r: (r[0], r[1] or "")
    assert sorted([(r.doc_id, r.text, r.lines_seen, r.lines_gone) for r in got.collect()], key=key) == sorted(want, key=key)
    assert sum(w[3] for w in want) > 40
    assert sum(1 for w in want if w[1] == "copied body of a page\nin two lines") == 40


def slow_rules(i, text, frequent):
    ws = words(text)
    windows = Counter(tuple(ws[k:k + 5]) for k in range(len(ws) - 4))
    covered = {p for k in range(len(ws) - 4) if windows[tuple(ws[k:k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    left = len(ws) - sum(len(words(x)) for x in lines if normal(x) in frequent)
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    kept = not failed and left >= 10 and 100 * left >= 30 * len(ws)
    return (i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, kept, left)


def normal(line):
    return " ".join("".join("0" if c in "0123456789" else c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(line))


@pytest.mark.parametrize("limits", [LIMITS, TINY])
def test_rules(spark, limits):
    sources = ("a", None)
    site_pages = pages_of(PAGES, sources)
    on = {s: Counter(x for p in pages for x in {normal(y) for y in p.split("\n") if words(y)}) for s, pages in site_pages.items()}
    frequent = {s: {x for x, n in c.items() if n >= 5 and n > 0.02 * len(site_pages[s])} for s, c in on.items()}
    want = [slow_rules(i, t or "", frequent[sources[i % 2]]) for i, t in enumerate(PAGES) for _ in range(2)]
    got = quality_rules(documents(spark, PAGES, sources, extra=True), limits=limits)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[6:8] for w in want} == {(True, False), (False, True), (False, False)}


def test_depleted_documents_are_rejected(spark):
    foot = "this same long line of exactly twelve words stands on every page"
    texts = [f"{foot}\nonly {'abcdefgh'[i]}" for i in range(8)]
    got = quality_rules(documents(spark, texts, ("a",))).collect()
    assert {(r.base_failed, r.kept, r.n_left) for r in got} == {(False, False, 2)}


def test_nothing(spark):
    assert drop_boilerplate(empty(spark)).count() == 0
    assert quality_rules(empty(spark)).count() == 0

"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.texts import ODD, documents, empty
from tipoff.limits import Limits
from tipoff.llm.components import components
from tipoff.llm.simhash import fingerprint, links, near_duplicates
from tests.llm.texts import SCHEMA

TINY = Limits(group_rows=20, block_rows=7, broadcast_rows=0, match_rows=10)


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {p: find(p) for p in ordered}


def test_fingerprints_by_hand():
    for text in ODD:
        text = text and text[:5000]
        assert fingerprint(text) == slow_fingerprint(text)


def test_hash_is_that_of_the_engine(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first().h
    assert got % (1 << 64) == fingerprint("One two THREE")


def clustered(seed, centres=30, near=40):
    random.seed(seed)
    found = {0, (1 << 64) - 1}
    for _ in range(centres):
        centre = random.getrandbits(64)
        for _ in range(near):
            p = centre
            for _ in range(random.randint(0, 7)):
                p ^= 1 << random.randrange(64)
            found.add(p)
    return sorted(found)


@pytest.mark.parametrize("group", [20_000, 12])
def test_links_connect_what_brute_force_connects(spark, group):
    prints = clustered(4)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = slow_components(prints)
    found = {p: p for p in prints}
    for r in components(links(frame, 3, group=group), "u", "v").collect():
        found[r.node % (1 << 64)] = r.root % (1 << 64)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(found) == groups(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 500)]
    frame = spark.createDataFrame(edges, "u long, v long")
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    for limits in (Limits(), TINY):  # with tiny limits the star's edges are spread over tasks
        assert dict(components(frame, "u", "v", limits=limits).collect()) == want


def texts_with_copies(seed=1):
    random.seed(seed)
    out = [*ODD, "", "one", "ONE"]
    for _ in range(12):
        words = [f"w{random.randrange(4000)}" for _ in range(400)]
        out.append(" ".join(words))
        for _ in range(5):
            copy = list(words)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("limits,group", [(Limits(), 20_000), (TINY, 8)])
def test_near_duplicates(spark, limits, group):
    texts = texts_with_copies()
    got = near_duplicates(documents(spark, texts, extra=True), limits=limits, group=group).collect()
    prints = [slow_fingerprint(t[:400_000] if t else t) if not t or len(t) < 5000 else fingerprint(t) for t in texts]
    classes = slow_components(set(prints))
    smallest = {}
    for i, p in enumerate(prints):
        smallest.setdefault(classes[p], i)
    want = sorted((i, f"{p:016x}", smallest[classes[p]]) for i, p in enumerate(prints) for _ in range(2))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_a_large_group_of_copies(spark):
    rows = [(i, "the very same text in every row", None, "s", None) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(frame, limits=TINY)
    assert [tuple(r) for r in got.select("component_id").distinct().collect()] == [(0,)] and got.count() == 300


def test_nothing(spark):
    assert near_duplicates(empty(spark)).count() == 0

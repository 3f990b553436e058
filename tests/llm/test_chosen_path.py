"""Chosen-path joins against all pairs, at every limit; odd rows."""

import random

import numpy as np
import pytest

from tests.llm.texts import ODD, SCHEMA, clashing, documents, empty
from tipoff.limits import Limits
from tipoff.llm import chosen_path as cp

TINY = Limits(group_rows=20, block_rows=7, broadcast_rows=0, match_rows=10)


def slow_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    return {f"{a} {b}" for a, b in zip(words, words[1:])} if len(words) > 1 else set(words)


def slow_classes(rows, percent=80):
    """{(id, text): (size, smallest id)} by all pairs of distinct texts."""
    sets = {t: slow_set(t) for _, t in rows}
    parent = {t: t for t in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = list(sets)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        least[find(t)] = min(least.get(find(t), i), i)
    return {(i, t): (len(sets[t]), least[find(t)] if sets[t] else i) for i, t in rows}


def texts(seed, groups=8, copies=24):
    random.seed(seed)
    word = lambda: random.choice("aeiou") + random.choice("bcdfgklmnprst") + random.choice(["", "an", "el", "or", "um", "is"])
    passage = [word() for _ in range(30)]
    found = []
    for g in range(groups):
        base = [word() for _ in range(random.choice([4, 6, 12, 40, 150]))]
        for _ in range(random.choice([1, 2, copies])):
            own = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, len(base) // 14])):
                own[random.randrange(len(own))] = word()
            if random.random() < 0.3:
                own = own[:max(1, len(own) - random.randrange(3))] + [word()] * random.randrange(3)
            found.append(" ".join(own))
            if random.random() < 0.2:
                found.append(" ".join(own).upper())
        found.append(" ".join(passage + [word() for _ in range(random.randrange(60))]))
    return found + ["b a b a", "a b a b", "a b", "A  b", "x x x x x x x", "x x"]


def checked(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    frame = clashing(frame, ("digest", "size", "tokens", "nodes", "node", "id", "root", "a.b", "TEXT", "lo"))
    got = cp.near_duplicates(frame, **options).collect()
    want = slow_classes(rows, options.get("percent", 80))
    expected = sorted((i, *want[i, t], i == want[i, t][1]) for i, t in rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == expected


@pytest.mark.parametrize("options", [{"percent": 90}, {"limits": TINY, "leaf": 20}])
def test_classes_by_all_pairs(spark, options):
    rows = [(i, t) for i, t in enumerate(texts(len(options)))]
    random.shuffle(rows)
    checked(spark, rows + rows[:20], **options)


def test_large_nodes_are_pivoted_and_branched(spark):
    """A large group of near copies, and many unlike texts with one passage: nothing is compared pair by pair."""
    random.seed(9)
    passage = [f"p{i}" for i in range(40)]
    base = [f"w{i}" for i in range(60)]
    found = [" ".join(base[:k] + [f"x{i}"] + base[k + 1:]) for i in range(150) for k in [random.randrange(60)]]
    found += [" ".join(passage + [f"y{i}{j}" for j in range(40)]) for i in range(150)]
    checked(spark, list(enumerate(found)), leaf=32)


def test_few_outside_the_largest_class_do_not_make_a_node_branch(spark, monkeypatch):
    """A large group of near copies, and some texts just too unlike it: these meet all the others in blocks."""
    random.seed(12)
    base = [f"w{i}" for i in range(60)]
    edited = lambda name, places: " ".join(f"{name}_{k}" if k in places else w for k, w in enumerate(base))
    found = [edited(f"x{i}", random.sample(range(60), 1)) for i in range(150)]
    found += [edited(f"y{i}", random.sample(range(1, 59, 2), 4)) for i in range(6)]
    found += [found[-1].replace("w58", "z"), found[-2].replace("w0", "z")]
    monkeypatch.setattr(cp, "_below", lambda members, depth: pytest.fail(f"branched at depth {depth}"))
    checked(spark, list(enumerate(found)), leaf=32)
    checked(spark, list(enumerate(found)), leaf=32, limits=TINY)


def test_whole_nodes_come_together():
    """A node of more rows than a batch has is not cut."""
    import pyarrow as pa

    nodes = [1] * 3 + [2] * 25 + [3] + [4] * 9
    rows = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(range(len(nodes)))], ["node", "at"])
    for size in (1, 4, 10, 40):
        got = [b.to_pydict() for b in cp._whole_nodes((rows.slice(i, size) for i in range(0, len(nodes), size)), 5)]
        assert [at for b in got for at in b["at"]] == list(range(len(nodes)))
        assert sorted(n for b in got for n in set(b["node"])) == [1, 2, 3, 4]


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    checked(spark, rows + rows)
    got = cp.near_duplicates(documents(spark, ODD, extra=True)).collect()
    assert len(got) == 2 * len(ODD)
    nameless = spark.createDataFrame([(None, "one two three four five six", None, None, None), (7, "one two three four five six", None, None, None),
                                      (None, "alone", None, None, None), (None, None, None, None, None)], SCHEMA)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in cp.near_duplicates(nameless).collect()}
    assert got == {(None, 5, 7, False), (7, 5, 7, True), (None, 1, None, True), (None, 0, None, True)}
    assert cp.near_duplicates(empty(spark)).count() == 0


def test_linked_pairs_share_bands_nodes_and_places():
    for percent in (80, 90):
        for small in range(4, 400):
            for large in range(small, small * 100 // percent + 1):
                assert set(cp.bands(small, percent)) & set(cp.bands(large, percent))
    assert max(cp.missed(0.8, depth) for depth in range(1, 5)) < 1e-4 > cp.missed(0.85, 8)
    assert cp.missed(0.8, 10) < 0.003
    random.seed(1)
    multipliers, met = cp._multipliers(1), []
    for _ in range(60):
        words = [f"w{random.randrange(10**9)}" for _ in range(181)]
        other = words[:160] + [f"w{random.randrange(10**9)}" for _ in range(21)]
        a, b = (cp.signature(cp.sketch([w.encode() for w in t])[1], multipliers) for t in (words, other))
        met.append((a == b).mean())
    assert abs(np.mean(met) - 159 / 201) < 0.03


def test_words_with_one_checksum_still_count_apart():
    import zlib

    seen, pair = {}, None
    for i in range(400_000):
        w = f"k{i}".encode()
        if zlib.crc32(w) in seen:
            pair = seen[zlib.crc32(w)], w
            break
        seen[zlib.crc32(w)] = w
    if pair:
        words = [b"a", pair[0], b"b", b"a", pair[1], b"b", b"c"]
        assert cp.sketch(words)[0] == len(cp.shingles(words))


def test_pairs_just_below_a_link_are_not_passed_on(spark, monkeypatch):
    """Texts of similarities around 0.7 share many places of their signatures; they are ruled out where they meet, pair by pair nothing comes out."""
    random.seed(11)
    base = [f"w{i}" for i in range(120)]
    found = []
    for i in range(80):
        own = list(base)
        for k in random.sample(range(0, 120, 2), 1 if i < 40 else 6):
            own[k] = f"x{i}_{k}"
        found.append(" ".join(own))
    passed, real = [], cp.confirmed
    monkeypatch.setattr(cp, "confirmed", lambda texts, pairs, **k: passed.append(pairs.count()) or real(texts, pairs, **k))
    checked(spark, list(enumerate(found)))
    assert sum(passed) <= len(found)

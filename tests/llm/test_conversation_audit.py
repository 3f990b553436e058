"""Conversation audits against an exhaustive search, very long conversations against whole ones, odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F, types as T

from tests.llm.texts import clashing
from tipoff.limits import Limits
from tipoff.llm import conversation_audit as ca

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])


def searched(turns, most):
    """Least (cost, letters) over all edits with at most two insertions at each place, by trying them all."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    choices = [["D"] if fault == 2 else ["D", "K", "Ru", "Ra"] for _, fault in turns]
    for edits in itertools.product(*choices):
        for extra in itertools.product(inserts, repeat=len(turns) + 1):
            letters, roles, cost = "I" * len(extra[0]), extra[0], 5 * len(extra[0])
            for (initial, fault), edit, more in zip(turns, edits, extra[1:]):
                cost += {"D": 2, "K": 0}.get(edit, 1) + (5 if fault == 1 and edit != "D" else 0) + 5 * len(more)
                roles += {"D": "", "K": initial}.get(edit, edit[1:]) + more
                letters += edit[0] + "I" * len(more)
            if LEGAL.fullmatch(roles) and (best is None or (cost, letters) < best):
                best = cost, letters
    return best


def test_audits_by_trying_all_edits():
    random.seed(3)
    for n in range(4):
        for turns in itertools.product([(i, f) for i in "suax" for f in range(3)], repeat=n):
            if n == 3 and random.random() > 0.01:
                continue
            codes = "".join(ca.code(i, ["", "truncated", "blank"][f]) for i, f in turns)
            assert ca.audit(codes) == searched(turns, 2), turns


def greedy(codes):
    """Least cost and letters by costs still to come, then the least letter that keeps to them."""
    ahead = [[0, 10, 5, 0]]
    user, other = ca.USER, [ca.START, ca.SYSTEM, ca.ASSISTANT]

    def moves(state, letter):
        kind, fault = divmod(ord(letter) - 65, 3)
        extra = [0, 5, 0][fault]
        yield "D", 2, state
        if fault < 2:
            kept = ca._FOLLOWS.get((state, "sua?"[kind]))
            if kept is not None:
                yield "K", extra, kept
            yield "R", extra + 1, ca.ASSISTANT if state == user else user

    def inserted(best):
        best = list(best)
        for _ in range(3):
            best = [min(b, 5 + best[ca.ASSISTANT if s == user else user]) for s, b in enumerate(best)]
        return best

    for letter in reversed(codes):
        ahead.append(inserted([min(c + ahead[-1][t] for _, c, t in moves(s, letter)) for s in range(4)]))
    ahead.reverse()
    state, out, at, total = ca.START, "", 0, ahead[0][0]
    while at < len(codes) or ahead[at][state]:
        options = [("I", 5, ca.ASSISTANT if state == user else user, at)]
        if at < len(codes):
            options += [(e, c, t, at + 1) for e, c, t in moves(state, codes[at])]
        edit, _, state, at = min(o for o in options if o[1] + ahead[o[3]][o[2]] == ahead[at][state])
        out += edit
    return total, out


def test_long_audits_by_another_way():
    random.seed(5)
    for n in (5, 30, 200, 1000):
        for weights in ([1] * 12, [5, 1, 1, 9, 1, 1, 9, 1, 1, 1, 1, 1], [1, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0]):
            codes = "".join(random.choices([chr(65 + i) for i in range(12)], weights, k=n))
            assert ca.audit(codes) == greedy(codes)


def test_prefixes_compare_as_their_letters_even_when_hashes_collide():
    random.seed(7)
    for base, prime in ((ca._BASE, ca._PRIME), (1, 2), (0, 3), (2, 5)):
        tree = ca.Prefixes(base, prime)
        for _ in range(300):
            tree.add(random.randrange(max(1, len(tree.letter) - 40), len(tree.letter)) if len(tree.letter) > 1 else 0, random.choice("DK"))
        texts = [tree.text(i) for i in range(len(tree.letter))]
        for _ in range(3000):
            a, b = random.randrange(len(texts)), random.randrange(len(texts))
            assert tree.less(a, b) == (texts[a] < texts[b])
            assert len(texts[a]) == tree.depth[a]


def chats(spark, extra=False):
    random.seed(11)
    rows = []
    for conv in (1, 2, 3, None):
        for turn in [None, *range(60)]:
            text = random.choice(["", " \n", "Yes.", "No", "Why? ", f"text {turn}.", f"text {turn}", None, "Yes."])
            rows += [(conv, turn, random.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), text)] * random.choice([1, 1, 1, 2])
    rows += [(4, 0, "user", "One."), (4, 1, "assistant", "Two."), (5, 7, "user", "x" * 300_000), (6, None, None, None)]
    rows += [(7, -(1 << 63), "user", "a."), (7, (1 << 63) - 1, "assistant", "b.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    return clashing(frame, ("conv", "present", "place", "block", "a.b", "TURN", "state", "letters", "copy")) if extra else frame


def collected(df):
    return sorted(map(tuple, df.select("conv_id", *ca.COUNTS, "audit", "repaired_sha256").collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_long_conversations_in_blocks(spark, block):
    whole = collected(ca.audit_conversations(chats(spark)))
    tiny = Limits(group_rows=10, block_rows=7, broadcast_rows=0, match_rows=10)
    assert collected(ca.audit_conversations(chats(spark, extra=True), limits=tiny, block=block)) == whole
    assert len(whole) == 8


def test_repaired_rows_and_their_hash(spark):
    found = ca.audit_conversations(chats(spark), with_rows=True).collect()
    for row in found:
        assert LEGAL.fullmatch("".join(r.role[:1] for r in row.repaired))
        joined = "\n".join(f"{r.role}:{r.text}" for r in row.repaired)
        assert hashlib.sha256(joined.encode()).hexdigest() == row.repaired_sha256
        assert row.audit.count("K") + row.audit.count("R") + row.audit.count("I") == len(row.repaired)
    by_id = {r.conv_id: r for r in found}
    assert (by_id[4].audit, by_id[4].cost, by_id[4].gaps) == ("KK", 0, 0)
    assert (by_id[5].audit, by_id[5].truncated, by_id[5].gaps) == ("D", 1, 0)
    assert (by_id[6].blank, by_id[6].audit, by_id[6].gaps) == (1, "D", 0)
    assert by_id[7].gaps == (1 << 63) - 1


def test_damage_and_conversations_without_rows(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)]
    damaged = ca.damaged(spark.createDataFrame(rows, SCHEMA))
    for c, t, group in ((r.conv_id, r.turn, r.g) for r in damaged.groupBy("conv_id", "turn").agg(
        F.collect_list(F.struct("role", "text", "present")).alias("g")).collect()):
        harm = zlib.crc32(f"{c}:{t}".encode()) % 20
        assert len(group) == (2 if harm == 3 else 1)
        assert group[0].present == (harm != 0)
        assert group[0].role == ("user" if harm == 4 else "assistant")
        assert group[0].text == {1: "", 2: "One Two"}.get(harm, "One. Two!")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    gone = chats(spark)
    for limits in (ca.LIMITS, Limits(group_rows=10, block_rows=7, broadcast_rows=0, match_rows=10)):
        got = collected(ca.audit_conversations(gone, present=F.lit(False), limits=limits))
        assert [r[1:] for r in got] == [nothing] * 8
    empty = ca.audit_conversations(spark.createDataFrame([], SCHEMA), with_rows=True)
    assert empty.count() == 0 and "repaired" in empty.columns

"""Near-duplicate documents by SimHash fingerprints and a self-join of binary tries.

Two fingerprints within ``max_bits`` differing bits agree in at least one of
``max_bits + 1`` blocks of bits. For each block the fingerprints are rotated so
that it leads, and a trie is formed below each value of it: those node pairs
start at no difference. Inside a trie, node pairs go down together, a differing
bit costs one unit of the budget, and a pair beyond the budget is dropped with
all below it. Tries with very many fingerprints are first split by the same
rule into pairs of deeper nodes, which become work of their own.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tipoff.limits import Limits
from tipoff.llm.components import components
from tipoff.operators.joins import join_dimension
from tipoff.session import materialize

BITS = 64
LEAF = 64  # node pairs with no more pairs of fingerprints than this are compared directly
FRONTIER = 1 << 18  # node pairs that are taken a bit further at a time
BATCH = 1 << 17  # fingerprints whose tries are joined together
GROUP = 20_000  # a trie with more fingerprints than this is split
STEP = 4  # bits by which such a trie is split
HASHES = 1 << 15  # hashes whose bits are counted at a time

_UPPER = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles; 0 for no words."""
    found = (text or "").encode().translate(_UPPER).split()
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(BITS, dtype=np.int64), len(found) - shingle + 1
    for at in range(0, total, HASHES):
        stop = min(total, at + HASHES)
        hashes = [digest(whole[s:e - 1], 42) for s, e in zip(starts[at:stop], ends[at + shingle - 1:])]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int, id_col: str, text_col: str, keep: tuple = ()) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def compute(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(0)]
            signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], signed], [*batch.schema.names[1:], "fp"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(compute, f"{schema}, fp long")


def _block(max_bits: int):
    """(first bit, width) of each block, from the highest bit down."""
    edges = [round(i * BITS / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its group) after joining the groups of left[i] and right[i]."""
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right = left[apart], right[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            short = labels[labels]
            if (short == labels).all():
                break
            labels = short


def _spread(counts: np.ndarray):
    """For each of sum(counts) items: its owner and its place within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def trie_links(values: np.ndarray, pairs: np.ndarray, max_bits: int) -> np.ndarray:
    """Group label of each value after linking all within ``max_bits`` bits below the given node pairs.

    ``values``: rotated fingerprints, sorted within each node. ``pairs``: rows
    (start a, end a, start b, end b, differing bits so far, depth); a node
    paired with itself is its own partner.
    """
    labels = np.arange(len(values))
    stack = [pairs[pairs[:, 5] == d] for d in np.unique(pairs[:, 5])]
    while stack:
        front = stack.pop()
        if len(front) > FRONTIER:
            stack += [front[FRONTIER:], front[:FRONTIER]]
            continue
        a0, a1, b0, b1, cost, depth = front.T
        own = a0 == b0
        size = np.where(own, (a1 - a0) * (a1 - a0 - 1) // 2, (a1 - a0) * (b1 - b0))
        at_leaf = (size <= LEAF) | (depth >= BITS)
        labels = _compare(values, labels, front[at_leaf & (size > 0)], max_bits)
        front = front[~at_leaf]
        if not len(front):
            continue
        depth = int(front[0, 5])
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1))]).astype(np.int64)
        a0, a1, b0, b1, cost, _ = front.T
        own = a0 == b0
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        down = np.full(len(front), depth + 1)
        below = np.concatenate([
            np.stack([a0, am, b0, bm, cost, down], 1),
            np.stack([am, a1, bm, b1, cost, down], 1),
            np.stack([a0, am, bm, b1, cost + 1, down], 1),
            np.stack([am, a1, b0, bm, cost + 1, down], 1)[~own],
        ])
        alive = (below[:, 4] <= max_bits) & (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])
        if alive.any():
            stack.append(below[alive])
    return labels


def _compare(values, labels, front, max_bits):
    """Link the pairs of fingerprints below small node pairs."""
    for at in range(0, len(front), FRONTIER // 16):
        a0, a1, b0, b1, _, _ = front[at:at + FRONTIER // 16].T
        owner, place = _spread((a1 - a0) * (b1 - b0))
        width = (b1 - b0)[owner]
        i, j = a0[owner] + place // width, b0[owner] + place % width
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= max_bits)
        labels = _merge(labels, i[near], j[near])
    return labels


def _work(prints: DataFrame, max_bits: int, group: int) -> DataFrame:
    """Rows (item, diff, depth, side, v): the node pairs at which tries begin, and the rotated fingerprints below them.

    side 0 and 1: the two nodes of a pair; 2: a node paired with itself.
    """
    turned = F.array(*[
        F.struct(
            F.lit(b).alias("b"), F.lit(width).alias("depth"),
            (F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", BITS - first)) if first else F.col("fp")).alias("v"),
        )
        for b, (first, width) in enumerate(_block(max_bits))
    ])
    items = prints.select(F.inline(turned)).select(
        F.xxhash64("b", F.expr(f"shiftrightunsigned(v, {BITS} - depth)")).alias("item"), "b", "depth",
        F.lit(0).alias("diff"), F.lit(2).alias("side"), "v",
    )
    # The item is a hash; b and the leading bits are compared again where tries are built.
    done = None
    while True:
        counts = items.groupBy("item").agg(F.count("*").alias("n"), F.min("depth").alias("d"))
        hot = counts.where((F.col("n") > group) & (F.col("d") + STEP <= BITS)).select("item")
        hot = materialize(hot)
        if hot.isEmpty():
            return items if done is None else done.unionByName(items)
        cold = items.join(hot, "item", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        items = materialize(_split(items.join(hot, "item", "left_semi"), max_bits))


def _split(items: DataFrame, max_bits: int) -> DataFrame:
    """The pairs of nodes STEP bits further down that stay within the budget."""
    own = F.expr(f"shiftrightunsigned(v, {BITS} - depth - {STEP}) & {(1 << STEP) - 1}").cast("int")
    other = F.explode(F.filter(
        F.sequence(F.lit(0), F.lit((1 << STEP) - 1)),
        lambda t: F.bit_count(t.bitwiseXOR(F.col("own"))) + F.col("diff") <= max_bits,
    ))
    pairs = items.withColumn("own", own).withColumn("other", other)
    left = F.when(F.col("side") == 2, F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    right = F.when(F.col("side") == 2, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    side = (
        F.when(F.col("side") != 2, F.col("side")).when(F.col("own") == F.col("other"), F.lit(2))
        .otherwise((F.col("own") > F.col("other")).cast("int"))
    )
    return pairs.select(
        F.xxhash64("item", left, right).alias("item"), "b", (F.col("depth") + STEP).alias("depth"),
        (F.col("diff") + F.bit_count(left.bitwiseXOR(right))).cast("int").alias("diff"), side.alias("side"), "v",
    )


def links(prints: DataFrame, max_bits: int = 3, *, group: int = GROUP) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all within ``max_bits`` bits of each other.

    Each task links what lies below its node pairs and hands on one edge per
    fingerprint that is not the first of its group, so large groups of near
    copies never give all their pairs.
    """
    turns = [first for first, _ in _block(max_bits)]

    def join(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            held.append(part)
            size += part.shape[1]
            if size >= BATCH:  # the last item may go on in the next batch
                rows = np.concatenate(held, axis=1)
                last = _first_of_last(rows[0])
                if last:
                    yield _edges(rows[:, :last], turns, max_bits)
                held, size = [rows[:, last:]], rows.shape[1] - last
        if held:
            yield _edges(np.concatenate(held, axis=1), turns, max_bits)

    work = _work(prints, max_bits, group)
    dealt = work.repartition("item").sortWithinPartitions("item", "b", "depth", "side", "v")
    return dealt.select("item", "b", "depth", "diff", "side", "v").mapInArrow(join, "u long, v long")


def _first_of_last(items: np.ndarray) -> int:
    """Where the run of the last item begins."""
    change = np.flatnonzero(items[1:] != items[:-1])
    return int(change[-1]) + 1 if len(change) else 0


def _edges(rows, turns, max_bits):
    item, b, depth, diff, side, v = rows
    values = v.view(np.uint64)
    lead = np.where(side == 2, values >> (BITS - depth).astype(np.uint64), 0)  # nodes with one hash of the item stay apart
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (b[1:] != b[:-1]) | (depth[1:] != depth[:-1]) | (side[1:] != side[:-1]) | (lead[1:] != lead[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(item))
    s = side[starts]
    own = s == 2
    pairs = [np.stack([starts, ends, starts, ends, diff[starts], depth[starts]], 1)[own]]
    first = np.flatnonzero(s == 0)
    partner = first[(first + 1 < len(starts))]
    partner = partner[(s[partner + 1] == 1) & (item[starts[partner + 1]] == item[starts[partner]])]
    k = partner + 1
    pairs.append(np.stack([starts[partner], ends[partner], starts[k], ends[k], diff[starts[partner]], depth[starts[partner]]], 1))
    labels = trie_links(values, np.concatenate(pairs), max_bits)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    back = np.array(turns, dtype=np.uint64)

    def original(i):
        turn = back[b[i]]
        return np.where(turn > 0, (values[i] >> turn) | (values[i] << ((np.uint64(BITS) - turn) % np.uint64(BITS))), values[i])

    u, w = original(moved).view(np.int64), original(labels[moved]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], ["u", "v"])


def near_duplicates(
    docs: DataFrame, *, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple = (), group: int = GROUP, limits: Limits = Limits(),
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row.

    Words are runs of non-white-space after lower-casing A-Z; a text without
    words has fingerprint zero, and so has a null one. Equal texts share a
    fingerprint and so a component; repeated rows give repeated result rows.
    ``keep`` carries further columns along; all others are ignored. Rows with
    one fingerprint are folded before anything is joined, all joins are on
    fingerprints, and one that very many rows share is spread over tasks.
    """
    rows = materialize(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col, keep=keep))
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    roots = components(links(prints.select("fp"), max_bits, group=group), "u", "v", limits=limits)
    linked = roots.join(prints.select(F.col("fp").alias("node"), "first"), "node")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"), F.count("*").alias("members"))
    named = join_dimension(linked.select("node", "root"), smallest, ["root"], rows="members", spread="node", limits=limits)
    classes = prints.join(named.select(F.col("node").alias("fp"), "smallest"), "fp", "left").select(
        "fp", "n", F.coalesce("smallest", "first").alias("component_id")
    )
    result = join_dimension(rows, classes, ["fp"], rows="n", spread="id", limits=limits)
    return result.select(
        F.col("id").alias(id_col), *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

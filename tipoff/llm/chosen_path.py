"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

Every distinct text has a signature of minwise tokens. Independent trees start
at bands of set sizes; texts go down together where they have the same minwise
tokens at the places of the signature that a path picks: some at once below
the root, one more at every node below. A node of few texts is compared
exhaustively: pairs across classes whose signatures agree well enough are
confirmed on the full sets of shingles where the node is, and only links that
join two classes come out, at most one a text. In a node of many all texts are
compared to one of them, drawn by a hash, which joins groups of copies without
all their pairs. Few texts outside its largest class then meet all the others,
which are dealt out in blocks; if they are many, the node branches again.
Confirmed links are contracted to classes.
"""

import zlib
from hashlib import blake2b
from itertools import chain
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tipoff.limits import Limits
from tipoff.llm.common import Positions
from tipoff.llm.components import components
from tipoff.operators.joins import join_dimension
from tipoff.operators.ordered import small
from tipoff.session import discard, materialize, materialize_counted

LIMITS = Limits(group_rows=200_000, block_rows=100_000, broadcast_rows=100_000, match_rows=200_000)

PLACES = 64  # minwise tokens of a signature
TREES, PATH = 16, 3  # independent trees, places that the path to the nodes below their roots has: unlike texts with a common passage seldom meet
WIDE, SHARE = 2, 4  # below, two branches down to depth WIDE, then one and for every SHAREth node another: 1 / similarity keeps work least
DEEP = 24  # nodes this deep are compared exhaustively whatever their size; only texts that are nearly equal get there together
AGREE = 36  # places of two signatures that agree at least where sets are compared; a linked pair agrees in 51 on average, or more
LEAF = 1024  # a node with no more texts is compared exhaustively
OTHERS = 2  # a larger node, if it has at most so many times LEAF texts outside its largest class: these with all, in blocks
SOONER = 5  # a node in so many is compared before the others, which then compare only what is not of one class yet
LEAST = 4  # smaller sets are linked only if they are equal
EDGES = 10_000  # links to a task, about, where they are contracted
CHUNK = 2048  # shingles hashed at a time
HELD = 1 << 22  # bytes of texts and signatures that a task takes at a time, or one node of few texts

_UPPER = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(seed: int) -> np.ndarray:
    return _mixed(np.arange(1, PLACES + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_UPPER).split()


def shingles(found: list[bytes]) -> set:
    """The distinct 2-word shingles; fewer words are one shingle of their own, none give none."""
    return set(zip(found, found[1:])) if len(found) > 1 else {tuple(found)} - {()}


def sketch(found: list[bytes]) -> tuple[int, np.ndarray | None]:
    """Exact size of the set of shingles, and their distinct hashes (None for a small set)."""
    if len(found) <= LEAST:
        return len(shingles(found)), None
    codes = np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found))
    hashes = np.unique((codes[:-1] << np.uint64(32)) | codes[1:])
    size = len(hashes)
    if len(np.unique(codes)) != len(set(found)):  # two words of this text with one checksum
        size = len(shingles(found))
    return size, _mixed(hashes) if size >= LEAST else None


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, np.multiply.outer(hashes[at:at + CHUNK], multipliers).min(axis=0), out=least)
    return least >> np.uint64(16)


def digest(found: list[bytes], size: int) -> bytes:
    """Names a text by its words; a small set by its shingles, so that equal small sets have one name."""
    if size >= LEAST:
        return blake2b(b" ".join(found), digest_size=16).digest()
    return blake2b(b"\n".join(sorted(b" ".join(s) for s in shingles(found))), digest_size=16, person=b"set").digest()


def bands(size: int, percent: int) -> list[int]:
    """Size bands of a set; two sets whose sizes allow a link share at least one."""
    place = log(size) / -log(percent / 100)
    band = floor(place / 4)
    return [band, band - 1] if place - 4 * band <= 1 + 1e-9 else [band]


def first_nodes(least: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Nodes below the roots of all trees: a band, places of the signature, and the tokens there."""
    trees, path = np.arange(TREES, dtype=np.uint64), np.zeros(TREES, dtype=np.uint64)
    for tokens in least[:TREES * PATH].reshape(PATH, TREES):
        path = _mixed(path ^ _mixed(tokens))
    found = [_mixed(path + (trees << np.uint64(32)) + np.uint64(b + 1)) for b in bands(size, percent)]
    return np.concatenate(found).view(np.int64)


def next_nodes(nodes: np.ndarray, signatures: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes below, and the row each comes from: a node draws places beyond those of the roots; the tokens there tell its children apart."""
    keys = nodes.view(np.uint64)
    rest, rows = PLACES - TREES * PATH, np.arange(len(keys))
    drawn = _mixed(keys + np.uint64(1))
    first = drawn % np.uint64(rest)
    step = np.uint64(1) + (drawn >> np.uint64(32)) % np.uint64(rest - 1)
    second = rows if depth <= WIDE else np.flatnonzero((drawn >> np.uint64(20)) % np.uint64(SHARE) == 0)
    out = []
    for j, some in enumerate((rows, second)):
        place = TREES * PATH + ((first[some] + np.uint64(j) * step[some]) % np.uint64(rest)).astype(np.int64)
        token = signatures[some, place].astype(np.uint64)
        out.append(_mixed(keys[some] ^ _mixed((token << np.uint64(8)) + place.astype(np.uint64))))
    return np.concatenate(out).view(np.int64), np.concatenate([rows, second])


def _array(column) -> np.ndarray:
    """Signatures of a binary column as rows of 16-bit tokens."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, PLACES)


def _agreeing(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """In how many places signatures agree, row by row; 0 where the sizes of the sets rule a link out."""
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return np.where(fits, (a == b).sum(axis=1), 0)


def sketched(docs: DataFrame, *, id_col: str, text_col: str, percent: int, seed: int) -> DataFrame:
    """id, digest (null without words), size of its set; signature, first nodes and text (null for a small set)."""

    def compute(batches):
        multipliers = _multipliers(seed)
        for batch in batches:
            names, sizes, tokens, nodes, texts = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                found = words_of(text)
                size, hashes = sketch(found)
                least = None if hashes is None else signature(hashes, multipliers)
                names.append(digest(found, size) if size else None)
                sizes.append(size)
                tokens.append(None if least is None else least.astype("<u2").tobytes())
                nodes.append(None if least is None else first_nodes(least, size, percent))
                texts.append(None if least is None else text)
            columns = [
                batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary()),
                pa.array(nodes, pa.list_(pa.int64())), pa.array(texts, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "size", "tokens", "nodes", "text"])

    own = Positions(docs)
    rows = own.frame.select(own[id_col].alias("id"), own[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(compute, f"id {kind}, digest binary, size long, tokens binary, nodes array<long>, text string")


def _dense(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct shingles of every text, one after the other, equal for equal shingles; and where each text's begin."""
    known: dict = {}
    found = []
    for text in texts:
        words = words_of(text)
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
        found.append(np.unique(codes[:-1] << 32 | codes[1:]))
    return np.unique(np.concatenate(found), return_inverse=True)[1], np.cumsum([0, *map(len, found)])


def near(rows: pa.RecordBatch, agree: int, percent: int) -> np.ndarray:
    """Rows whose signature agrees with one of another class in their node; ``rows``: whole nodes of node, digest, size, tokens, root, sorted."""
    nodes, sizes, tokens = rows.column(0).to_numpy(), rows.column(2).to_numpy(), _array(rows.column(3))
    root = rows.column(4).dictionary_encode().indices.to_numpy()
    found = np.zeros(len(nodes), dtype=bool)
    for step in range(1, len(nodes)):
        left = np.flatnonzero(nodes[:-step] == nodes[step:])
        if not len(left):
            break
        left = left[root[left] != root[left + step]]
        left = left[_agreeing(tokens[left], tokens[left + step], sizes[left], sizes[left + step], percent) >= agree]
        found[left] = found[left + step] = True
    return np.flatnonzero(found)


def joins(rows: pa.RecordBatch, agree: int, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of rows of one node that join classes, no two of them the same classes.

    ``rows``: whole nodes of node, digest, size, tokens, root, text, sorted by
    node. Pairs across classes whose signatures agree are compared by their full sets.
    """
    own = near(rows, agree, percent)
    if not len(own):
        return []
    nodes, sizes, tokens = rows.column(0).to_numpy()[own], rows.column(2).to_numpy()[own], _array(rows.column(3))[own]
    root = rows.column(4).dictionary_encode().indices.to_numpy()[own]
    shared, begin = _dense(rows.column(5).take(pa.array(own)).to_pylist())
    n, mark = np.diff(begin), np.zeros(len(shared), dtype=bool)
    found, ends = [], np.searchsorted(nodes, nodes, "right")
    for i, end in enumerate(ends):
        others = i + 1 + np.flatnonzero(root[i + 1:end] != root[i])
        others = others[_agreeing(tokens[others], tokens[i], sizes[others], sizes[i], percent) >= agree]
        if not len(others):
            continue
        mine = shared[begin[i]:begin[i + 1]]
        mark[mine] = True
        both = np.array([np.count_nonzero(mark[shared[begin[j]:begin[j + 1]]]) for j in others])
        mark[mine] = False
        for j in others[100 * both >= percent * (n[i] + n[others] - both)]:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                found.append((int(own[i]), int(own[j])))
    return found


def _whole_nodes(batches, leaf: int):
    """Rows sorted by node, some whole nodes at a time: about ``leaf`` rows, or one node of more."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held = batch if held is None or not held.num_rows else pa.concat_batches([held, batch])
        while held is not None and held.num_rows and (batch is None or held.num_rows > leaf):
            nodes = held.column(0).to_numpy()
            whole = len(nodes) if batch is None else int(np.searchsorted(nodes, nodes[-1]))  # the last node may go on
            if not whole:
                break
            stop = min(whole, max(leaf, 1), max(1, HELD * len(nodes) // max(held.nbytes, 1)))
            if stop < len(nodes):  # where a node ends: the last that ends before, or the first
                stop = int(np.searchsorted(nodes, nodes[stop])) or int(np.searchsorted(nodes, nodes[0], "right"))
            yield held.slice(0, stop)
            held = held.slice(stop)


def _near_rows(members: DataFrame, agree: int, percent: int, leaf: int) -> DataFrame:
    """node, digest, root of the members (node, digest, size, tokens, root) that have to be compared by their texts."""

    def compare(batches):
        for rows in _whole_nodes(batches, leaf):
            yield rows.select(["node", "digest", "root"]).take(pa.array(near(rows, agree, percent)))

    own = members.select("node", "digest", "size", "tokens", "root").repartition("node").sortWithinPartitions("node")
    return own.mapInArrow(compare, "node long, digest binary, root binary")


def _links_inside(members: DataFrame, agree: int, percent: int, leaf: int) -> DataFrame:
    """Confirmed links that join classes inside nodes or blocks (node, digest, size, tokens, root, text)."""

    def compare(batches):
        for rows in _whole_nodes(batches, leaf):
            found, names = joins(rows, agree, percent), rows.column(1)
            a, b = (names.take(pa.array([pair[end] for pair in found], pa.int64())) for end in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    own = members.select("node", "digest", "size", "tokens", "root", "text").repartition("node").sortWithinPartitions("node")
    return _ordered(own.mapInArrow(compare, "a binary, b binary"), "a", "b")


def _compared(members: DataFrame, agree: int, percent: int, leaf: int, every: bool) -> DataFrame:
    """Pairs of texts of unlike root in one small node (node, digest, size, tokens, root) whose signatures agree.

    All are compared; ``every`` such pair comes out, or for each text the pairs
    with the best earlier and the best later one.
    """

    def compare(batches):
        """Rows come sorted by node; a row meets the next ones of its node, all nodes of a batch at once."""
        held = None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows or batch is not None and held.num_rows < 2 * leaf:
                continue
            nodes = held.column(0).to_numpy()
            stop = len(nodes) if batch is None else int(np.searchsorted(nodes, nodes[-1]))  # the last node may go on
            names, sizes, tokens = held.column(1), held.column(2).to_numpy()[:stop], _array(held.column(3))[:stop]
            roots = held.column(4).dictionary_encode().indices.to_numpy()
            lo, hi = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            best = np.full((2, stop), -1, dtype=np.int64)  # agreement and distance of the best later and the best earlier text
            for step in range(1, stop):
                left = np.flatnonzero(nodes[:stop - step] == nodes[step:stop])
                if not len(left):
                    break
                left = left[roots[left] != roots[left + step]]
                equal = _agreeing(tokens[left], tokens[left + step], sizes[left], sizes[left + step], percent)
                near, equal = left[equal >= agree], equal[equal >= agree]
                if every:
                    lo.append(near)
                    hi.append(near + step)
                else:
                    mark = (equal << 32) + step
                    best[0, near] = np.maximum(best[0, near], mark)
                    best[1, near + step] = np.maximum(best[1, near + step], mark)
            for (one, other), marks in zip(((lo, hi), (hi, lo)), best):
                found = np.flatnonzero(marks >= 0)
                step = marks[found] & 0xFFFFFFFF
                one.append(found)
                other.append(found + step if one is lo else found - step)
            a, b = names.take(pa.array(np.concatenate(lo))), names.take(pa.array(np.concatenate(hi)))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])
            held = held.slice(stop)

    own = members.select("node", "digest", "size", "tokens", "root").repartition("node").sortWithinPartitions("node")
    return _ordered(own.mapInArrow(compare, "a binary, b binary"), "a", "b")


def _to_pivots(members: DataFrame, agree: int, percent: int) -> DataFrame:
    """Pairs of a text and its node's pivot (digest, size, tokens, pivot, pivot_size, pivot_tokens) that agree."""

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _array(batch.column(2)), _array(batch.column(5))
                equal = _agreeing(a, b, batch.column(1).to_numpy(), batch.column(4).to_numpy(), percent)
                yield batch.select(["digest", "pivot"]).filter(pa.array(equal >= agree))

    own = members.where("digest != pivot").select("digest", "size", "tokens", "pivot", "pivot_size", "pivot_tokens")
    return _ordered(own.mapInArrow(compare, "digest binary, pivot binary"), "digest", "pivot")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def _below(members: DataFrame, depth: int) -> DataFrame:
    """Members (node, digest) of the nodes below, at ``depth``; ``members`` have tokens."""

    def branch(batches):
        for batch in batches:
            if batch.num_rows:
                nodes, rows = next_nodes(batch.column(0).to_numpy(), _array(batch.column(2)), depth)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), batch.column(1).take(pa.array(rows))], ["node", "digest"])

    return members.select("node", "digest", "tokens").mapInArrow(branch, "node long, digest binary")


def _each(texts: DataFrame, rows: DataFrame, columns: list[str], limits: Limits) -> DataFrame:
    """digest and more columns, once for each digest of ``rows``."""
    wanted, n = materialize_counted(rows.select("digest").distinct())
    named = texts.select("digest", *columns).join(small(wanted, n, limits), "digest", "left_semi")
    return named.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in columns])


def confirmed(texts: DataFrame, pairs: DataFrame, *, percent: int, limits: Limits) -> DataFrame:
    """Those of the pairs lo, hi whose full sets of shingles are similar enough; ``texts``: written rows of digest, text."""

    def check(batches):
        known = [None, None]  # a text that pairs in a row share is cut into shingles once
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a = a.as_py()
                if known[0] != a:
                    known = [a, shingles(words_of(a))]
                one, two = known[1], shingles(words_of(b.as_py()))
                both = len(one & two)
                linked.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["lo", "hi"]).filter(pa.array(linked, pa.bool_()))

    named = materialize(_each(texts, pairs.select(F.explode(F.array("lo", "hi")).alias("digest")), ["text"], limits))
    left, right = (named.withColumnsRenamed({"digest": end, "text": name}) for end, name in (("lo", "a"), ("hi", "b")))
    # Adaptive joins split a text that very many pairs share.
    both = pairs.join(left, "lo").join(right, "hi").select("lo", "hi", "a", "b")
    return both.mapInArrow(check, "lo binary, hi binary")


class Classes:
    """What is known of the links between texts: the classes (node, root) so far, pairs that were checked, and pairs put off."""

    def __init__(self, texts: DataFrame, percent: int, limits: Limits):
        self.texts, self.percent, self.limits = texts, percent, limits
        self.found = self.checked = self.put_off = None
        self.links = 0  # confirmed so far: the edges of the stars are no more

    def rooted(self, rows: DataFrame, name: str = "digest", root: str = "root") -> DataFrame:
        """``rows`` with the class of a column."""
        if self.found is None:
            return rows.withColumn(root, F.col(name))
        known = self.found.withColumnsRenamed({"node": name, "root": "reached"})
        return rows.join(known, name, "left").withColumn(root, F.coalesce("reached", name)).drop("reached")

    def learn(self, pairs: DataFrame | None, every: bool = False) -> None:
        """Check pairs that may join classes, and join them: ``every`` such pair, or at first the smallest partners of each text.

        The smallest partners make a star of most groups of copies; other pairs
        are put off, and checked later if they still lie across classes.
        """
        if self.put_off is not None:
            pairs = self.put_off if pairs is None else pairs.union(self.put_off).distinct()
        if pairs is None:
            return
        if self.found is not None:
            pairs = self.rooted(self.rooted(pairs, "lo", "x"), "hi", "y").where("x != y").select("lo", "hi")
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["lo", "hi"], "left_anti")
        pairs, n = materialize_counted(pairs)
        self.put_off = None
        if not n:
            return
        if not every:
            best = lambda key, other: pairs.groupBy(key).agg(F.min(other).alias(other)).select("lo", "hi")
            chosen, some = materialize_counted(best("lo", "hi").union(best("hi", "lo")).distinct())
            self.put_off = pairs.join(chosen, ["lo", "hi"], "left_anti") if some < n else None
            pairs = chosen
        self.checked = pairs if self.checked is None else self.checked.union(pairs)
        self.join(confirmed(self.texts, pairs, percent=self.percent, limits=self.limits))

    def join(self, links: DataFrame) -> None:
        """Join the classes of confirmed links lo, hi."""
        links, n = materialize_counted(links)
        if not n:
            return
        if self.found is not None:
            links = links.union(self.found.where("node != root").select(F.col("root").alias("lo"), F.col("node").alias("hi")))
        self.links += n
        self.found = components(links, "lo", "hi", limits=self.limits, tasks=8 + self.links // EDGES)


def _mixed_nodes(rooted: DataFrame) -> DataFrame:
    """Nodes, and their rows, that have texts of more than one class."""
    mixed = rooted.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("rows"))
    return mixed.where("least != most").select("node", "rows")


def _largest_classes(rooted: DataFrame) -> DataFrame:
    """Nodes that have texts of more than one class: rows, their largest class, and rows outside it."""
    each = rooted.groupBy("node", "root").agg(F.count("*").alias("own"))
    found = each.groupBy("node").agg(F.sum("own").alias("rows"), F.max(F.struct("own", "root")).alias("most"))
    return found.select("node", "rows", F.col("most.root").alias("main"), F.expr("rows - most.own").alias("others")).where("others > 0")


def _blocks(rows: DataFrame, leaf: int) -> DataFrame:
    """Blocks (node, digest, root) of nodes (node, digest, root, main, others, texts): texts of the largest class are dealt out, others go to each block."""
    blocks = F.ceil((F.col("texts") - F.col("others")) / leaf).cast("int")
    own = F.when(F.col("root") == F.col("main"), F.array(F.pmod(F.xxhash64("digest"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
    return rows.withColumn("block", F.explode(own)).select(F.xxhash64("node", "block").alias("node"), "digest", "root")


def links(
    sets: DataFrame, texts: DataFrame, *, percent: int = 80, limits: Limits = LIMITS, leaf: int = LEAF, agree: int = AGREE,
) -> tuple[DataFrame | None, list[int]]:
    """Classes (node, root) of linked texts, or None; and how many rows nodes of each depth had.

    ``sets``: written digest, size, tokens, nodes of distinct texts.
    """
    known = sets.select("digest", "size", "tokens")
    named = known.withColumnsRenamed({"digest": "pivot", "size": "pivot_size", "tokens": "pivot_tokens"})
    members, classes, held = sets.select("digest", F.explode("nodes").alias("node")), Classes(texts, percent, limits), []
    while True:
        nodes, n = materialize_counted(members.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1"))
        if not n:
            break
        placed, some = materialize_counted(
            join_dimension(members, nodes.withColumn("texts", F.col("rows")), ["node"], rows="rows", spread="digest", limits=limits, row_bound=n)
        )
        held.append(some)
        joined = lambda rows, dim: join_dimension(rows, dim, ["node"], rows="rows", spread="digest", limits=limits, row_bound=n)
        large, many = materialize_counted(nodes.where(F.col("rows") > leaf))
        if many:
            order = F.struct(F.xxhash64("node", "digest").alias("order"), "digest")
            around = placed.where(F.col("texts") > leaf)
            pivots = around.groupBy("node").agg(F.min(order)["digest"].alias("pivot"), F.count("*").alias("rows"))
            pivots = materialize(pivots.join(named, "pivot"))
            classes.learn(_to_pivots(joined(around, pivots).join(known, "digest"), agree, percent))
            discard(pivots)
        sooner = F.pmod("node", F.lit(SOONER)) == 0
        rounds = (sooner, ~sooner) if len(held) == 1 else (F.lit(True),)
        for at, some_nodes in enumerate(rounds, 1):
            few = classes.rooted(placed.where((F.col("texts") <= leaf) & some_nodes)).select("node", "digest", "root")
            if classes.found is not None:
                few = joined(few, _mixed_nodes(few)).select("node", "digest", "root")
            if many and at == len(rounds):
                around = classes.rooted(placed.where(F.col("texts") > leaf))
                mixed = materialize(_largest_classes(around))
                blocked = F.col("others") <= OTHERS * leaf
                few = few.union(_blocks(joined(around, mixed.where(blocked)), leaf))
                wide, many = materialize_counted(mixed.where(~blocked).select("node", "rows"))
            few, some = materialize_counted(_near_rows(few.join(known, "digest"), agree, percent, leaf))
            if some:
                whole = _each(texts, few, ["size", "tokens", "text"], limits)
                classes.join(_links_inside(few.join(whole, "digest"), agree, percent, leaf))
            discard(few)
        if many:
            rooted = classes.rooted(joined(placed, wide))
            members, many = materialize_counted(joined(rooted, _mixed_nodes(rooted)).select("node", "digest"))
        if many and len(held) < DEEP:
            members, many = materialize_counted(_below(members.join(known, "digest"), len(held)))
        elif many:
            for every in (False, True):  # first what joins groups of copies, then whatever is left across classes
                classes.learn(_compared(classes.rooted(members.join(known, "digest")), agree, percent, leaf, every), every)
            many = 0
        for done in (placed, nodes, large):
            discard(done)
        if not many:
            break
    classes.learn(None, every=True)
    return classes.found, held


def near_duplicates(
    docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    limits: Limits = LIMITS, leaf: int = LEAF, agree: int = AGREE, seed: int = 1,
) -> DataFrame:
    """id, n_shingles, component_id, kept for every row.

    Texts are linked whose sets of 2-word shingles (A-Z lower-cased; the whole
    text if it has one word) share at least ``percent`` hundredths of their
    union; classes are what links reach, named by their smallest id. A text
    without words is linked with nothing, not even with its like. Texts with
    the same words, or with equal sets of under four shingles, are one node, so
    copies cost a row each; every confirmed link compares whole sets.

    Every input row gives a row, repeated ones too. A null text has no words. A
    null id names no class unless all its ids are null. ``kept``: the id is the
    class's. Other columns are ignored. :func:`missed` gives the probability
    that a linked pair shares no node, or that its signatures agree too little;
    at a similarity of 0.8 it is below 0.00005 down to depth 4, where a node of
    ten million texts has become small, and below 0.003 at depth 10. Whatever
    is found is confirmed. Jobs run when this is called.
    """
    rows = materialize(sketched(docs, id_col=id_col, text_col=text_col, percent=percent, seed=seed))
    large = rows.where("nodes IS NOT NULL")
    sets = materialize(large.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in ("size", "tokens", "nodes")]))
    classes, _ = links(sets, large, percent=percent, limits=limits, leaf=leaf, agree=agree)
    texts = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    texts = texts.withColumn("root", F.col("digest"))
    if classes is not None:
        roots = classes.withColumnsRenamed({"node": "digest", "root": "reached"})
        texts = texts.join(roots, "digest", "left").withColumn("root", F.coalesce("reached", "digest"))
    texts = materialize(texts.select("digest", "least", "copies", "root"))
    named = texts.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("rows"))
    named = join_dimension(texts, named, ["root"], rows="rows", spread="digest", limits=limits).select("digest", "component", "copies")
    own = rows.select("id", "digest", "size")
    worded = join_dimension(own.where("digest IS NOT NULL"), named, ["digest"], rows="copies", spread="id", limits=limits)
    result = worded.unionByName(own.where("digest IS NULL").withColumn("component", F.col("id")))
    return result.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def missed(similarity: float, depth: int, agree: int = AGREE) -> float:
    """Probability that a pair of this similarity shares no node ``depth`` branchings down, or agrees in too few places."""
    from math import comb

    dead = 0.0
    for below in range(depth - 1, 0, -1):
        one = 1 - similarity + similarity * dead
        dead = one * one if below <= WIDE else one * (1 - 1 / SHARE) + one * one / SHARE
    unmet = (1 - similarity ** PATH * (1 - dead)) ** TREES
    differ = sum(comb(PLACES, k) * similarity ** k * (1 - similarity) ** (PLACES - k) for k in range(agree))
    return unmet + differ


ORACLE = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w != '') AS words FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) < 2 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS found FROM lowered
), sized AS (
  SELECT doc_id, len(found)::BIGINT AS n, found FROM sets
), items AS (
  SELECT doc_id, n, unnest(found) AS shingle FROM sized
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b
    ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reached(node, root) AS (
  SELECT doc_id, doc_id FROM sized
  UNION
  SELECT y, root FROM reached JOIN edges ON x = node WHERE root < y
), classes AS (
  SELECT node, min(root) AS component_id FROM reached GROUP BY node
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sized JOIN classes ON node = doc_id
"""

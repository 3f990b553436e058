"""Phrases of two to five words whose parts occur together more often than apart, counted in direct-address tiles.

Words that are frequent enough get ids by frequency. A pair of units (a frequent
phrase and the word after it) is a cell of a table whose rows and columns are
these ranks. The table is cut into tiles: a tile that a batch fills densely is
counted by one ``bincount`` over its cells, the cells of thin tiles are counted
as sorted coordinates. Cells are dealt into buckets, shuffled as packed steps
from cell to cell, and added up bucket by bucket; frequent pairs
become the units of the next length, are ranked again, and the next word is
joined to them, up to the longest phrases.

Only a bounded number of units of each length has a rank, and a pair of ranks is
a name of its own; the others keep a 64-bit name, a bitmap of fixed size tells which names may be frequent, and their
pairs are coordinates by name. A wrong yes of the bitmap costs rows, not
results. Names of different units that meet are noticed where counts are
added, and that length is counted again under other names. Texts are read
twice: to count words, and to write them as numbers that all lengths share.
"""

from collections.abc import Callable
from hashlib import blake2b
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tipoff.llm.common import Positions
from tipoff.session import discard, materialize

HEAD = 1 << 16  # units of each length that have a rank
TILE = 1 << 10  # ranks along the side of a tile
DENSE = 1 << 14  # pairs of a batch that fall into a tile counted cell by cell
BATCH = 1 << 18  # words whose pairs are counted at a time
WORDS = 1 << 19  # words counted one by one at a time
PART = 1 << 17  # words of one written row of numbers
BITS = 1 << 25  # of the bitmap for units without a rank
CACHE = 1 << 18  # different words of a task whose names are kept
HELD = 1 << 19  # counted pairs that a task holds before it adds them up
ROWS = 64  # of counted pairs that a task passes on at a time
TRIES = 5

_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in b",;:!?\n\x0b\x0c\r":
    _TABLE[_c] = ord(".")
_TABLE[ord("\t")] = ord(" ")
_TABLE = bytes(_TABLE)
STOP = b"."  # no word holds one


def tokens_of(text: str | None) -> list[bytes]:
    """Words in order, and STOP where a piece ends."""
    return (text or "").encode().translate(_TABLE).replace(STOP, b" . ").split()


def mixed(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """The name of a pair of units; never 0."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(salt << 32 | 0x5BD1E995))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def word_name(lang: str, word: bytes, salt: int, mask: int) -> int:
    """The 64-bit name of a word of a language; never 0."""
    found = blake2b(word, digest_size=8, key=blake2b(lang.encode(), digest_size=16).digest(), salt=bytes([salt])).digest()
    return int.from_bytes(found, "little") & mask | 1


class Units:
    """The frequent units of one length: ranks of the first ones, a bitmap for the rest."""

    def __init__(self, names: np.ndarray, bitmap: bytes | None, salt: int):
        self.salt, self.names = salt, names  # by rank
        order = np.argsort(names)
        self.sorted, self.rank = names[order], order.astype(np.int64)
        self.bits = None if bitmap is None else np.frombuffer(bitmap, dtype=np.uint8)

    def ranks(self, names: np.ndarray) -> np.ndarray:
        """Rank of every name, -1 for one without a rank that may be frequent, -2 for one that is not."""
        out = np.full(len(names), -2, dtype=np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, names), len(self.sorted) - 1)
            known = self.sorted[at] == names
            out[known] = self.rank[at[known]]
        if self.bits is not None:
            place = names % np.uint64(BITS)
            may = (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            out[(out == -2) & (may == 1)] = -1
        out[names == 0] = -2
        return out


def count_pairs(left: np.ndarray, right: np.ndarray, tile: int = TILE, dense: int = DENSE):
    """Distinct pairs of ranks and their counts, by tiles."""
    across = -(-(int(right.max(initial=0)) + 1) // tile)
    of = left // tile * across + right // tile
    filled = np.bincount(of)
    full = np.flatnonzero(filled >= dense)
    found = []
    order = np.argsort(of, kind="stable") if len(full) else None
    ends = np.cumsum(filled)
    for t in full:
        rows = order[ends[t] - filled[t]:ends[t]]
        cells = np.bincount(left[rows] % tile * tile + right[rows] % tile, minlength=tile * tile)
        cell = np.flatnonzero(cells)
        found.append((t // across * tile + cell // tile, t % across * tile + cell % tile, cells[cell]))
    thin = filled[of] < dense
    if thin.any():
        keys, counts = np.unique(left[thin] << 32 | right[thin], return_counts=True)
        found.append((keys >> 32, keys & 0xFFFFFFFF, counts))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 3


def count_names(left: np.ndarray, right: np.ndarray):
    """The same for pairs of names, as sorted coordinates."""
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])[:len(left)])
    return left[first], right[first], np.diff(np.append(first, len(left)))


class Names(dict):
    """Numbers of a language's words, made when a word is first asked for; 0 for STOP."""

    def __init__(self, lang: str, name_of: Callable[[str, bytes], int]):
        super().__init__({STOP: 0})
        self.lang, self.name_of = lang, name_of

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.name_of(self.lang, word)
        return found


def _batched(batches, name_of: Callable[[str, bytes], int], renew: bool, size_of: int):
    """(numbers of the words in order, 0 where a piece ends; numbers by language and word) of some words at a time.

    With ``renew`` every part begins with no known word.
    """
    known: dict = {}
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = known.get(lang)
            if own is None:
                own = known[lang] = Names(lang, name_of)
            tokens = tokens_of(text)
            tokens.append(STOP)
            held.append(np.fromiter(map(own.__getitem__, tokens), dtype=np.uint64, count=len(tokens)))
            size += len(tokens)
            if size >= size_of:
                yield np.concatenate(held), known
                held, size = [], 0
                if renew or sum(map(len, known.values())) > CACHE:
                    known = {}
    if held:
        yield np.concatenate(held), known


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n, of parts of the rows."""

    def count(batches):
        place = iter(range(1, 1 << 62))
        for numbers, known in _batched(batches, lambda lang, word: next(place), renew=True, size_of=WORDS):
            found, counts = np.unique(numbers, return_counts=True)
            at = dict(zip(found.tolist(), counts.tolist()))
            rows = [(lang, word.decode(), at[number]) for lang, own in known.items() for word, number in own.items() if number]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "word", "n"])

    return docs.mapInArrow(count, "lang string, word string, n long")


def _named_words(docs: DataFrame, mask: int, at_least: int) -> tuple[DataFrame, int]:
    """Written lang, word, n, name, under the first salt where no frequent word shares its name; and the salt."""
    words = materialize(_word_counts(docs).groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def name(batches, salt):
        for batch in batches:
            each = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            names = np.array([word_name(lang, word.encode(), salt, mask) for lang, word in each], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names.view(np.int64))], [*batch.schema.names, "name"])

    for salt in range(TRIES):
        named = materialize(words.mapInArrow(lambda batches, salt=salt: name(batches, salt), "lang string, word string, n long, name long"))
        met = named.groupBy("name").agg(F.count("*").alias("words"), F.max("n").alias("n"))
        if met.where((F.col("words") > 1) & (F.col("n") >= at_least)).isEmpty():
            return named, salt
        discard(named)
    raise RuntimeError("names of different words keep meeting")


def _encoded(docs: DataFrame, words, mask: int) -> DataFrame:
    """The texts as numbers, written once for all lengths: codes (int32), and the names of words without a rank (uint64).

    A code is 0 for a piece's end or a rare word, rank + 1, or -1 - i for the
    i-th name of its own row. Rows hold the words of many texts.
    """

    def encode(batches):
        single = Units(*words.value)
        for names, _ in _batched(batches, lambda lang, word: word_name(lang, word, single.salt, mask), renew=False, size_of=PART):
            rank = single.ranks(names)
            codes = np.where(rank >= 0, rank + 1, 0)
            tails, at = np.unique(names[rank == -1], return_inverse=True)
            codes[rank == -1] = -1 - at
            kept = np.ones(len(codes), dtype=bool)
            kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0)  # one break says as much as several
            yield pa.RecordBatch.from_arrays(
                [pa.array([codes[kept].astype("<i4").tobytes()]), pa.array([tails.astype("<u8").tobytes()])], ["codes", "tails"]
            )

    return materialize(docs.mapInArrow(encode, "codes binary, tails binary"))


def _names(batches, single: Units):
    """(names, ranks) of ``BATCH`` words or more at a time; 0 and -2 for a break."""
    held, size = [], 0
    for row in ((c.as_py(), t.as_py()) for batch in batches for c, t in zip(batch.column(0), batch.column(1))):
        codes, tails = np.frombuffer(row[0], dtype="<i4").astype(np.int64), np.frombuffer(row[1], dtype="<u8")
        names, ranks = np.zeros(len(codes), dtype=np.uint64), np.full(len(codes), -2, dtype=np.int64)
        head, tail = codes > 0, codes < 0
        ranks[head] = codes[head] - 1
        names[head] = single.names[ranks[head]]
        ranks[tail], names[tail] = -1, tails[-1 - codes[tail]]
        held.append((np.append(names, np.uint64(0)), np.append(ranks, -2)))
        size += len(codes)
        if size >= BATCH:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _hashed(left: np.ndarray, right: np.ndarray, salt: int, mask: int) -> np.ndarray:
    """Names of pairs of which a part has no rank: all above the names of other pairs."""
    return mixed(left, right, salt) & np.uint64(mask) | np.uint64(1 | 1 << 63)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, the lowest of all first: what is small or alike then compresses well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Stripes:
    """Buckets of pairs of ranks, that every hot row and column of their table is dealt over; ``across`` ranks on the right."""

    STEP = 40503

    def __init__(self, across: int, buckets: int):
        self.across, self.buckets, self.wide = max(across, 1), buckets, -(-max(across, 1) // buckets)

    def dealt(self, keys: np.ndarray):
        """(bucket, places in it, rows of ``keys``); keys left * across + right rise, and so do the places."""
        left, right = keys // self.across, keys % self.across
        bucket = (left * self.STEP + right) % self.buckets
        place = left * self.wide + right // self.buckets
        for rows in _by_bucket(bucket, self.buckets):
            yield int(bucket[rows[0]]), place[rows], rows

    def keys(self, bucket: int, place: np.ndarray) -> np.ndarray:
        left = place // self.wide
        right = place % self.wide * self.buckets + (bucket - left * self.STEP) % self.buckets
        return left * self.across + right


def _by_bucket(bucket: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Rows of each bucket that has some, in order."""
    order = np.argsort(bucket, kind="stable")
    return [rows for rows in np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1]) if len(rows)]


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _summed_names(parts: list) -> list[np.ndarray]:
    """The same for (left, right, count) of names."""
    left, right, counts = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))[:len(left)])
    return [left[first], right[first], np.add.reduceat(counts, first) if len(first) else counts]


def _pair_counts(encoded: DataFrame, levels: list, length: int, salt: int, mask: int, buckets: int) -> DataFrame:
    """Counts, by parts of the rows, of pairs of a frequent phrase of ``length`` - 1 words and the word after it.

    A row holds many pairs of one bucket: of ranks (l: steps between their
    places; r is null), or of names (l and r; the bucket goes by the pair's name); n: their counts.
    """

    def ranked_rows(stripes, held):
        if held:
            keys, counts = _summed(*zip(*held))
            held.clear()
            for bucket, place, own in stripes.dealt(keys):
                yield bucket, _planes(np.diff(place, prepend=0)), None, _planes(counts[own])

    def named_rows(held):
        if held:
            left, right, counts = _summed_names(held)
            held.clear()
            bucket = (_hashed(left, right, salt, mask) % np.uint64(buckets)).astype(np.int64)
            for own in _by_bucket(bucket, buckets):
                yield int(bucket[own[0]]), *(_planes(c[own]) for c in (left, right, counts))

    def count(batches):
        units = [Units(*u.value) for u in levels]
        across = np.uint64(len(units[0].names))
        stripes = Stripes(len(units[0].names), buckets)
        held, named_held = [], []
        for names, single in chain(_names(batches, units[0]), [(None, None)]):
            if names is not None:
                phrase, rank, step = names, single, 1
                while True:
                    ends = max(len(names) - step, 0)  # places where a phrase of step words is followed by another word
                    alive = (rank[:ends] > -2) & (single[step:] > -2)
                    if step > 1:
                        alive &= rank[1:ends + 1] > -2  # what the longer phrase ends with is frequent too
                    if step == length - 1:
                        break
                    following = np.zeros(ends, dtype=np.uint64)
                    following[alive] = _hashed(phrase[:ends][alive], names[step:][alive], units[step].salt, mask)
                    both = alive & (rank[:ends] >= 0) & (single[step:] >= 0)
                    following[both] = rank[:ends][both].astype(np.uint64) * across + single[step:][both].astype(np.uint64) + np.uint64(1)
                    phrase, rank, step = following, units[step].ranks(following), step + 1
                at = np.flatnonzero(alive)
                ranked = at[(rank[at] >= 0) & (single[at + step] >= 0)]
                named = at[(rank[at] < 0) | (single[at + step] < 0)]
                a, b, n = count_pairs(rank[ranked], single[ranked + step])
                held.append((a * stripes.across + b, n))
                if len(named):
                    named_held.append(count_names(phrase[named], names[named + step]))
            if names is not None and sum(len(k) for k, _ in held) + sum(len(p[0]) for p in named_held) < HELD:
                continue
            rows = chain(ranked_rows(stripes, held), named_rows(named_held))  # made as they go out, not all at once
            while some := list(islice(rows, ROWS)):
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], ["bucket", "l", "r", "n"])

    return encoded.mapInArrow(count, "bucket int, l binary, r binary, n binary")


def _totals(parts: DataFrame, levels: list, salt: int, mask: int, buckets: int, at_least: int) -> DataFrame:
    """name, l, r, n of the pairs that all parts together have ``at_least`` times; clash: their name has another meaning too."""

    def add(batches):
        units = [Units(*levels[i].value) for i in (-1, 0)]
        stripes = Stripes(len(units[1].names), buckets)
        held, named, size, most = [], [], 0, HELD
        for row in ((c.as_py() for c in row) for batch in batches for row in zip(*batch.columns)):
            bucket, left, right, n = row
            counts = _from_planes(n).astype(np.int64)
            if right is None:
                held.append((stripes.keys(bucket, np.cumsum(_from_planes(left).astype(np.int64))), counts))
            else:
                named.append((_from_planes(left), _from_planes(right), counts))
            size += len(counts)
            if size >= most:
                held, named = [_summed(*zip(*held))] if held else [], [_summed_names(named)] if named else []
                size = sum(len(p[0]) for p in (*held, *named))
                most = max(HELD, 2 * size)
        if held:
            keys, counts = _summed(*zip(*held))
            keys, counts = keys[counts >= at_least], counts[counts >= at_least]
            left, right = units[0].names[keys // stripes.across], units[1].names[keys % stripes.across]
            yield _rows(keys.astype(np.uint64) + np.uint64(1), left, right, counts, np.zeros(len(keys), dtype=bool))
        if named:
            left, right, counts = _summed_names(named)
            found, at = np.unique(_hashed(left, right, salt, mask), return_inverse=True)
            often = np.bincount(at, counts, len(found)) >= at_least
            clash = (often & (np.bincount(at, minlength=len(found)) > 1))[at]
            kept = clash | (counts >= at_least)
            yield _rows(found[at][kept], left[kept], right[kept], counts[kept], clash[kept])

    own = parts.repartition(buckets, "bucket")
    return own.mapInArrow(add, "name long, l long, r long, n long, clash boolean")


def _rows(name, left, right, counts, clash) -> pa.RecordBatch:
    numbers = [pa.array(c.view(np.int64)) for c in (name, left, right, counts)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array(clash)], ["name", "l", "r", "n", "clash"])


def _added(build: Callable[[int], DataFrame]) -> tuple[DataFrame, int]:
    """Written name, l, r, n of the frequent pairs, under the first salt where no frequent name has two meanings; and the salt."""
    for salt in range(TRIES):
        counted = materialize(build(salt))
        if counted.where("clash").isEmpty():
            return counted.select("name", "l", "r", "n"), salt
        discard(counted)
    raise RuntimeError("names of different units keep meeting")


def _units(spark: SparkSession, frequent: DataFrame, salt: int, head: int):
    """What :class:`Units` takes, broadcast: at most ``head`` names by rank, and a bitmap of ``BITS`` bits if there are more."""
    first = frequent.orderBy(F.desc("n"), "name").select("name").limit(head + 1).toArrow().column(0).to_numpy()
    names, bitmap = first[:head].view(np.uint64), None
    if len(first) > head:
        place = F.col("name").bitwiseAND(F.lit(BITS - 1))
        words = frequent.select(place.alias("place")).groupBy(F.expr("place div 64").alias("at")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")
        ).toArrow()  # at most BITS / 64 rows
        bits = np.zeros(BITS // 64, dtype=np.int64)
        bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
        bitmap = bits.tobytes()
    return spark.sparkContext.broadcast((names.copy(), bitmap, salt))


def collocations(
    docs: DataFrame, *, at_least: int = 100, longest: int = 5, first: int = 2000, lang_col: str = "lang", text_col: str = "text",
    head: int = HEAD, mask: int = (1 << 64) - 1,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to ``longest`` words.

    A-Z is lower-cased, texts are split at ``.,;:!?`` and line ends, and pieces
    into words at spaces and tabs. Per language (null: ``und``), n counts all
    words and f all occurrences of a phrase, overlapping ones too. Phrases with
    a = f of ``at_least`` or more are cut after each word; the least
    floor(1000 a n / (l r)) counts, l and r being f of the two parts, and of
    equal ones the earliest cut. A phrase inside a longer one that is as
    frequent is dropped. The ``first`` by score, then a (both falling), then
    phrase in byte order stay.

    Null and empty texts have no words; repeated rows count each time; other
    columns are ignored. Counting is exact: see the module on ranks and names.
    ``head`` and ``mask`` (of names) change plans, not results. Jobs run, and
    tables are written, when this is called.
    """
    spark = docs.sparkSession
    own = Positions(docs)
    texts = own.frame.select(F.coalesce(own[lang_col], F.lit("und")).alias("lang"), own[text_col].alias("text")).where("text IS NOT NULL")
    words, salt = _named_words(texts, mask, at_least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= at_least)
    singles = frequent.select("name", "lang", "word", F.col("n").alias("r_n"))
    phrases = [materialize(frequent.select("name", "lang", F.col("word").alias("phrase"), "n", F.lit(1).alias("words")))]
    levels = [_units(spark, frequent, salt, head)]
    encoded = _encoded(texts, levels[0], mask)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for length in range(2, longest + 1):
        frequent, salt = _added(lambda s: _totals(
            _pair_counts(encoded, levels, length, s, mask, buckets), levels, s, mask, buckets, at_least
        ))
        left = phrases[-1].select(F.col("name").alias("l"), "lang", F.col("phrase").alias("head"))
        right = singles.select(F.col("name").alias("r"), "word")
        phrases.append(materialize(frequent.join(left, "l").join(right, "r").select(
            "name", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), "n", F.lit(length).alias("words")
        )))
        levels.append(_units(spark, frequent, salt, head))
    known = phrases[0]
    for more in phrases[1:]:
        known = known.union(more)
    return _scored(known.select("lang", "phrase", "n", "words"), totals, first)


def _scored(known: DataFrame, totals: DataFrame, first: int) -> DataFrame:
    part = lambda at, size, name: F.array_join(F.slice("each", at, size), " ").alias(name)
    candidates = known.where("words > 1").withColumn("each", F.split("phrase", " "))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k"), "head"), part(F.col("k") + 1, F.col("words") - F.col("k"), "tail")
    )
    own = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    longer = candidates.where("words > 2")
    inside = longer.select("lang", F.explode(F.array(
        part(F.lit(1), F.col("words") - 1, "x"), part(F.lit(2), F.col("words") - 1, "x")
    )).alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(a as decimal(18,0)) * cast(total as decimal(18,0)) * cast(1000 as decimal(4,0))) div (l * r)")
    scored = (
        cuts.join(own("head", "l"), ["lang", "head"]).join(own("tail", "r"), ["lang", "tail"]).join(totals, "lang")
        .withColumns({"l": wide("l"), "r": wide("r")}).withColumn("score", score)
    )
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("cut")).select("lang", "phrase", "cut.*")
    kept = least.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select(
        "lang", F.col("rank").cast("long"), "phrase", F.col("a").cast("long"), F.col("l").cast("long"), F.col("r").cast("long"),
        F.col("total").cast("long").alias("n"), F.col("score").cast("long"),
    )


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, text FROM documents
), cut AS (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM pieces
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w != '') AS words FROM cut
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest(range(1, 6)) AS size) WHERE len(words) >= size
), counted AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase
), totals AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM counted WHERE size = 1 GROUP BY lang
), frequent AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE f >= 100
), cuts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size > 1)
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = head JOIN frequent y ON y.lang = c.lang AND y.phrase = tail
  JOIN totals t ON t.lang = c.lang
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(words[p:p + part - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - part + 2)) AS p FROM (SELECT *, unnest(range(2, size)) AS part FROM frequent WHERE size > 2))
  ) GROUP BY lang, phrase
)
SELECT least.lang, row_number() OVER (PARTITION BY least.lang ORDER BY score DESC, a DESC, least.phrase) AS rank,
  least.phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM least LEFT JOIN inside ON inside.lang = least.lang AND inside.phrase = least.phrase
WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""

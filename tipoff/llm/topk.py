"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tipoff.operators.ordered import with_position
from tipoff.session import discard, materialize, materialize_counted, new_path

SCALE = 256
LEVELS = (1, 4, 16)  # segments per vector
BLOCK = 4096  # queries broadcast at a time
ROWS = 512  # candidates compared at a time
PAIRS = 1 << 19  # pairs of a query and a candidate in a tile
NUMBERS = 1 << 20  # components of single pairs fetched at a time
HELD = 1 << 22  # components of the queries broadcast at a time, at most
FEW = 1 / 64  # of a tile: from here on single pairs are cheaper than a product of matrices
EXACT = 1 << 53  # below it, sums of whole numbers in doubles are exact
EXACT_FLOAT = 1 << 24  # and in floats
SLACK = {np.float32: 1e-4, np.float64: 1e-9}
NONE = np.iinfo(np.int64).min  # no score
RESULT = "query_id long, rank int, vec_id long, score long"


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component, and not null itself."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(wide, finite), F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) as doubles; a large double is whole already and need not fit a long."""
    def down(x):
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) >= float(EXACT), scaled).otherwise(F.floor(scaled).cast("double"))

    return F.transform(vector, down)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; an error where one does not fit a long."""
    largest = np.abs(left).max(initial=0.0) * np.abs(right).max(initial=0.0) * max(1, left.shape[1])
    if largest < EXACT:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    found = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(left.tolist(), right.tolist())]
    if any(abs(s) >= 1 << 63 for s in found):
        raise OverflowError("an inner product does not fit a long")
    return np.array(found, dtype=np.int64)


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles, zeros behind shorter ones."""
    lengths = np.array(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width  # a query has no component beyond its own longest
    out[owner[inside], place[inside]] = flat[inside]
    return out


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations per segment: their products bound inner products from above.

    In a segment of length L, the inner product is L * mean * mean plus that
    of the rests, which is at most deviation * deviation.
    """
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    columns = []
    for part in parts:
        values = x[:, part]
        mean = values.mean(axis=1, keepdims=True) if len(part) else np.zeros((len(x), 1))
        columns += [math.sqrt(len(part)) * mean[:, 0], np.sqrt(((values - mean) ** 2).sum(axis=1))]
    return np.stack(columns, axis=1)


class Search:
    """The k best candidates of each query of one block among the rows seen so far.

    Candidates meet the queries in tiles of at most PAIRS pairs. A bound is a product of matrices over a
    whole tile until it leaves few pairs, which are then fetched, NUMBERS components at a time. So what a tile takes
    depends on PAIRS and NUMBERS, not on how much the bounds prune.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels=LEVELS):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = levels
        self.norm = largest_norm(vectors)
        self.held = {np.float64: [*(segment_statistics(vectors, s) for s in levels), vectors]}
        self.best = np.empty((0, 3), dtype=np.int64)  # query place, score, candidate
        self.least = np.full(len(ids), NONE)  # k-th best score, once there are k
        self.last = np.full(len(ids), np.iinfo(np.int64).max)  # and whose it is
        self.waiting, self.waits = [], 0  # rows that may be among the best
        self.compared = 0  # pairs that the bounds left, and the first ones

    def add(self, ids: np.ndarray, vectors: np.ndarray):
        fine = [*(segment_statistics(vectors, s) for s in self.levels), vectors]
        rows = max(1, PAIRS // max(1, len(self.ids)))
        for at in range(0, len(ids), rows):
            self._tile(ids[at:at + rows], [x[at:at + rows] for x in fine])

    def result(self) -> np.ndarray:
        """Query place, score and candidate of the best."""
        self._merge()
        return self.best

    def _tile(self, ids, theirs):
        # By Cauchy and Schwarz no product, and no sum of some of its terms, is larger: below 2^24 floats are exact too.
        size = max(1.0, self.norm) * max(1.0, largest_norm(theirs[-1]))
        kind = np.float32 if size < EXACT_FLOAT else np.float64
        if kind not in self.held:
            self.held[kind] = [x.astype(kind) for x in self.held[np.float64]]
        mine, vectors, theirs = self.held[kind], theirs[-1], [x.astype(kind, copy=False) for x in theirs]
        self._first(ids, vectors, mine[0], theirs[0])
        slack = SLACK[kind] * size  # rounding of a bound
        least = np.where(self.least == NONE, -np.inf, self.least)
        floor = (least - slack).astype(kind)
        pairs, left = None, len(self.ids) * len(ids)
        for a, b in zip(mine[:-1], theirs[:-1]):
            if pairs is None:
                below = a @ b.T < floor[:, None]  # a bound that is not a number rules nothing out
                left = below.size - np.count_nonzero(below)
                pairs = places(~below) if left < FEW * below.size else None
            else:
                parts = [~(np.einsum("ij,ij->i", a[q], b[c]) < floor[q]) for q, c in slices(*pairs, a.shape[1])]
                alive = np.concatenate([np.empty(0, dtype=bool), *parts])
                pairs = pairs[0][alive], pairs[1][alive]
                left = len(pairs[0])
        self.compared += left
        if pairs is None:
            score = mine[-1] @ theirs[-1].T
            if size < EXACT:
                q, c = places(score >= least.astype(kind)[:, None])
                self._found(q, c, ids, score[q, c].astype(np.int64))
                return
            pairs = places(~(score < floor[:, None]) | ~(np.abs(score) + slack < 2.0**63))
        self._fetch(*pairs, ids, vectors)

    def _first(self, ids, vectors, mine, theirs):
        """First exact scores for the most promising, where a query has no k yet."""
        few = np.flatnonzero(self.least == NONE)
        if len(few):
            bound = mine[few] @ theirs.T
            some = np.argpartition(-bound, min(self.k, bound.shape[1] - 1), axis=1)[:, :self.k + 1]
            self.compared += some.size
            self._fetch(np.repeat(few, some.shape[1]), some.ravel(), ids, vectors)
            self._merge()

    def _fetch(self, q, c, ids, vectors):
        """Exact scores of single pairs."""
        for q, c in slices(q, c, vectors.shape[1]):
            other = self.ids[q] != ids[c]
            q, c = q[other], c[other]
            self._found(q, c, ids, scores(self.vectors[q], vectors[c]))

    def _found(self, q, c, ids, score):
        good = (score > self.least[q]) | (score == self.least[q]) & (ids[c] < self.last[q])
        good &= self.ids[q] != ids[c]
        self.waiting.append(np.stack([q[good], score[good], ids[c[good]]], axis=1))
        self.waits += np.count_nonzero(good)
        if self.waits >= 4 * self.k * len(self.ids):
            self._merge()

    def _merge(self):
        rows = np.concatenate([self.best, *self.waiting])
        self.waiting, self.waits = [], 0
        rows = rows[np.lexsort((-rows[:, 1], rows[:, 2], rows[:, 0]))]  # one row per query and candidate
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])
        rows = rows[new]
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], np.arange(len(self.ids)))
        place = np.arange(len(rows)) - starts[rows[:, 0]]
        self.best = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]
        self.last[last[:, 0]] = last[:, 2]


def largest_norm(vectors: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0)))


def places(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each true entry."""
    return np.divmod(np.flatnonzero(alive), alive.shape[1])


def slices(q: np.ndarray, c: np.ndarray, width: int):
    """Pairs whose rows of ``width`` numbers are fetched at a time."""
    step = max(1, NUMBERS // max(1, width))
    for at in range(0, len(q), step):
        yield q[at:at + step], c[at:at + step]


def exact_top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = SCALE, id_col: str = "vec_id",
    vector_col: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of every query row.

    Components are floor(scale * x), so scores are whole numbers and exact,
    whatever their size (one beyond a long is an error); ties go to the smaller id. Candidates are all rows but those with the
    query's own id. Null vectors, vectors with a null or non-finite component
    and rows without an id take no part. Repeated rows of an id count once, by
    their best score; of repeated query rows the largest vector asks. Of two
    vectors the shorter one counts as filled up with zeros. Fewer candidates
    give fewer rows, none gives none.

    The whole numbers are written once. Queries go out in blocks of ``block``
    (fewer if they have more than HELD components), each broadcast and held
    against all candidates where they lie; a task hands on at most k rows per
    query. No candidate is moved. A block's results are written before the next
    block goes out, so driver and tasks hold one block at a time; the search
    runs when this is called.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = materialize(
        rows.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
    )
    asked = rows.where("asks").groupBy("id").agg(F.max("v").alias("v"))
    asked, total = materialize_counted(with_position(asked, ["id"], "place"))
    candidates = rows.select("id", "v")
    widest = asked.agg(F.max(F.size("v"))).first()[0]
    block = min(block, max(1, HELD // max(1, widest or 0)))
    path = new_path(spark)
    for start in range(0, total, block):
        held = asked.where(F.col("place").between(start, start + block - 1)).select("id", "v").toArrow()
        width = max(1, pa.compute.max(pa.compute.list_value_length(held.column("v"))).as_py())
        ids = held.column("id").to_numpy()
        shipped = spark.sparkContext.broadcast((ids, matrix(held.column("v").combine_chunks(), width)))
        found = candidates.mapInArrow(_searcher(shipped, width, k), "query_id long, vec_id long, score long")
        _ranked(found, k).write.mode("append").parquet(path)
        shipped.destroy()
    discard(rows)
    discard(asked)
    if not total:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(path)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of what the tasks found for each query."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(shipped, width, k):
    def search(batches):
        ids, asking = shipped.value
        state = Search(ids, asking, k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                state.add(part.column(0).to_numpy(), matrix(part.column(1), width))
        q, score, found = state.result().T
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return search


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.w, v.w) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""

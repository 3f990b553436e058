"""Document quality by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and so has every chosen pair
of features. The tables grow by boosting: in each cycle every feature in turn
adds a shallow tree over its own bins to its table, so no feature can take
another's place. Then pairs, found by how much a split in both explains of what
is left, do the same. A score is a sum of table entries.
"""

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tipoff.llm.common import Positions, held_out
from tipoff.llm.labelled import SAMPLE, predicted, sigmoid, training_labels
from tipoff.session import materialize

FEATURES = [
    "log_words", "upper", "symbols", "bangs", "bars", "digits", "distinct", "top_word", "repeats", "dup_lines",
    "word_length", "log_line_words", "stops", "commas", "high_bytes", "distinct_pairs", "marked_words", "odd_lines",
]
BINS, PAIR_BINS = 32, 8
PAIRS = 8
CYCLES, PAIR_CYCLES = 120, 60
RATE, SHRINK = 0.1, 2.0
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate([
    range(97, 123), range(65, 91), b"#*$%&<>^~_=\\", b"!", b"|", range(48, 58), b".?", b",;:", range(128, 256),
], start=1):
    for _b in _bytes:
        _CLASS[_b] = _k


def features(text: str) -> list[float]:
    """Shape of one text, by FEATURES; all zero but for empty ratios if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    lower, upper, symbol, bang, bar, digit, stop, comma, high = np.bincount(_CLASS[raw], minlength=10)[1:].tolist()
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    odd = sum(1 for x in lines if x.isupper() or "|" in x or "*" in x or "%" in x or "!!" in x)
    marked = sum(v for w, v in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?")
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    return [
        np.log1p(n), upper / (lower + upper + 1), symbol / n, bang / n, bar / n, digit / len(raw), len(counts) / n,
        max(counts.values()) / n, repeats / n, 1 - len(set(lines)) / len(lines), (len(raw) - n + 1) / n,
        np.log1p(n / len(lines)), stop / n, comma / n, high / len(raw), pairs, marked / n, odd / len(lines),
    ]


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table of id and features of every row."""

    def measure(batches):
        for batch in batches:
            rows = [features(t.as_py() or "") for t in batch.column(0)]
            flat = pa.array(np.array(rows, dtype=np.float32).ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), flat)
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], ["id", "x"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    return materialize(rows.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>"))


@dataclass
class Model:
    base: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (i, j, edges of i, edges of j, table)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, ei, ej, table in self.pairs:
            total += table[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return sigmoid(total)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def _leaf(g, h):
    return -g / (h + SHRINK)


def _gain(g, h):
    return g * g / (h + SHRINK)


def _cut(g: np.ndarray, h: np.ndarray):
    """(gain, place) of the best split of consecutive bins; place bins go left."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    best = int(np.argmax(gains))
    return float(gains[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree with at most three leaves."""
    gain, cut = _cut(g, h)
    if gain <= 0:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    sides = [slice(0, cut), slice(cut, len(g))]
    cuts = [_cut(g[s], h[s]) for s in sides]
    deeper = int(np.argmax([c[0] for c in cuts]))
    if cuts[deeper][0] > 0:
        s = sides.pop(deeper)
        middle = s.start + cuts[deeper][1]
        sides += [slice(s.start, middle), slice(middle, s.stop)]
    out = np.empty(len(g))
    for s in sides:
        out[s] = _leaf(g[s].sum(), h[s].sum())
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of the better tree that splits one feature of a pair and then, on each side, the other."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, a.shape[0]):
            gain, out = -_gain(a.sum(), b.sum()), np.empty_like(a)
            for s in (slice(0, cut), slice(cut, a.shape[0])):
                ga, hb = a[s].sum(0), b[s].sum(0)
                more, place = _cut(ga, hb)
                gain += _gain(ga.sum(), hb.sum()) + max(more, 0)
                parts = [slice(0, place), slice(place, len(ga))] if more > 0 else [slice(0, len(ga))]
                for p in parts:
                    out[s, p] = _leaf(ga[p].sum(), hb[p].sum())
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, *, cycles: int = CYCLES, pair_cycles: int = PAIR_CYCLES, pairs: int = PAIRS) -> Model:
    """The model for rows ``x`` and labels ``y``; every fifth row only says when to stop.

    Without both labels, a constant.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Model(float(np.log(rate / (1 - rate))))
    if len(y) < 10 or y.min() == y.max():
        return model
    model.edges = [_edges(column, BINS) for column in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    learn = np.arange(len(y)) % 5 != 4
    total = np.full(len(y), model.base)

    def loss():
        z = total[~learn]
        return float(np.mean(np.logaddexp(0, z) - y[~learn] * z))

    def slopes(place, size):
        p = sigmoid(total[learn])
        at = place[learn]
        return np.bincount(at, p - y[learn], size), np.bincount(at, p * (1 - p), size)

    def boost(rounds, step, save):
        nonlocal total
        best, kept, since = loss(), save(), 0
        for _ in range(rounds):
            step()
            now = loss()
            since += 1
            if now < best - 1e-6:
                best, kept, since = now, save(), 0
            elif since >= 15:
                break
        return kept

    def cycle():
        nonlocal total
        for k, table in enumerate(model.tables):
            more = RATE * _tree(*slopes(bins[k], len(table)))
            table += more
            total = total + more[bins[k]]

    model.tables = boost(cycles, cycle, lambda: [t.copy() for t in model.tables])
    total = model.base + sum(t[b] for t, b in zip(model.tables, bins))

    coarse = [_edges(column, PAIR_BINS) for column in x.T]
    cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)
    place = lambda i, j: cells[i] * shape(i, j)[1] + cells[j]
    grid = lambda i, j: [s.reshape(shape(i, j)) for s in slopes(place(i, j), shape(i, j)[0] * shape(i, j)[1])]
    ranked = sorted(
        ((-_grid_tree(*grid(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), key=lambda r: r
    )
    chosen = [(i, j) for _, i, j in ranked[:pairs]]
    grids = [np.zeros(shape(i, j)) for i, j in chosen]

    def pair_cycle():
        nonlocal total
        for (i, j), table in zip(chosen, grids):
            more = RATE * _grid_tree(*grid(i, j))[1]
            table += more
            total = total + more[cells[i], cells[j]]

    grids = boost(pair_cycles, pair_cycle, lambda: [t.copy() for t in grids])
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(chosen, grids)]
    return model


def learned(table: DataFrame, labels: DataFrame, target: str, sample: int) -> Model:
    """A model of the sampled labelled rows of a feature table; ``sample`` rows of features reach the driver."""
    known = training_labels(labels, target, sample=sample)
    one = table.join(known, "id").groupBy("id").agg(F.max("y").alias("y"), F.max("x").alias("x"))
    rows = one.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows.column("y").to_numpy().astype(np.float64))


def score_quality(
    docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    The model learns ``labels.quality`` of at most ``sample`` documents outside
    the held-out fold, from the shape of whole texts alone. Empty and null
    texts are scored like any other, with zeros for features. Repeated rows
    give repeated results; of repeated rows of a training document one counts.
    With no labels, or one kind only, scores are constant. No shuffle but that of
    the sampled rows: texts are read once, and features written for both uses.
    """
    table = measured(docs, id_col, text_col)
    model = learned(table, labels, "quality", sample)

    def score(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    scored = table.mapInArrow(score, f"id {table.schema['id'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        predicted(F.col("score"), threshold).alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that the model rejects; the texts are not shuffled."""
    own = Positions(docs)
    table = measured(own.frame.select(own[id_col].alias("id"), own[text_col].alias("text")), "id", "text")
    model = learned(table, labels, "quality", sample)

    def keep(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = np.array([features(t.as_py() or "") for t in texts], dtype=np.float32).astype(np.float64)
            good = model.score(rows.reshape(-1, len(FEATURES))) >= threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:-1]], batch.schema.names[:-1])

    return own.restored(own.frame.select("*", own[text_col].alias("text")).mapInArrow(keep, own.frame.schema))

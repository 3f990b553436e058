"""Sums of products over a whole table that do not depend on how its rows are dealt out, to the last bit.

A number is cut into slices of ``SLICE`` bits below a power of two that bounds
its column. Slices are whole numbers, so the products of two slices, added up
over a batch by one matrix product, are exact; batches and tasks add whole
numbers, in limbs that fit a long, and the finished sum is a fraction. What is
cut off is the part of a number below 2^-(SLICE * SLICES) of its column's
bound, the same wherever the row is.
"""

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import frexp, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SLICE, SLICES = 18, 4
ROWS = 1 << 16  # rows whose products are added up in doubles: 2 * SLICE + 16 bits, within 53
LIMB = 60


def bounds(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """A power of two above the size of every column; 1 for one without a number. One aggregation."""
    row = df.agg(F.array(*[F.max(F.abs(c.cast("double"))) for c in columns])).first()[0]
    return np.array([power_above(v or 0.0) for v in row])


def power_above(value: float) -> float:
    if not isfinite(value):
        raise ValueError("a number is not finite")
    return 2.0 ** frexp(value)[1] if value else 1.0


def sliced(values: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
    """Whole-number slices, the highest first; every step is exact."""
    rest, out = values / bound, []
    for _ in range(SLICES):
        rest = rest * 2.0**SLICE
        whole = np.rint(rest)
        out.append(whole)
        rest = rest - whole
    return out


def batch_products(left: np.ndarray, right: np.ndarray, left_bound: np.ndarray, right_bound: np.ndarray) -> np.ndarray:
    """Sum over rows of left[i] * right[j] in units of the last slices, as Python integers."""
    total = np.zeros((left.shape[1], right.shape[1]), dtype=object)
    for at in range(0, len(left), ROWS):
        x, y = sliced(left[at:at + ROWS], left_bound), sliced(right[at:at + ROWS], right_bound)
        for s in range(SLICES):
            for t in range(SLICES):
                shift = SLICE * (2 * SLICES - 2 - s - t)
                total += (x[s].T @ y[t]).astype(np.int64).astype(object) * (1 << shift)
    return total


def summed_products(
    df: DataFrame, fold: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]],
    left_bound: np.ndarray, right_bound: np.ndarray,
) -> np.ndarray:
    """Sum over all rows of left[i] * right[j], as fractions, for the matrices that ``fold`` makes of a batch.

    Equal for every partitioning and order of the rows as long as ``fold``
    treats each row by itself, and no value exceeds its bound.
    """
    size = len(left_bound) * len(right_bound)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(left_bound), len(right_bound)), dtype=object)
        for batch in batches:
            if batch.num_rows:
                left, right = fold(batch)
                if (np.abs(left) > left_bound).any() or (np.abs(right) > right_bound).any():
                    raise ValueError("a value exceeds its bound")
                total += batch_products(left, right, left_bound, right_bound)
        slots, limbs, values = [], [], []
        for slot, value in enumerate(total.ravel()):
            limb = 0
            while value:
                sign = -1 if value < 0 else 1
                slots.append(slot)
                limbs.append(limb)
                values.append(sign * (abs(value) & ((1 << LIMB) - 1)))
                value, limb = sign * (abs(value) >> LIMB), limb + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int32()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], names=["slot", "limb", "value"]
        )

    parts = df.mapInArrow(partial, "slot int, limb int, value long")
    sums = parts.groupBy("slot", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    whole = [0] * size
    for row in sums.collect():  # at most a few limbs a slot
        whole[row.slot] += int(row.value) << (LIMB * row.limb)
    unit = Fraction(1, 1 << (2 * SLICE * SLICES))
    scales = [Fraction(a) * Fraction(b) * unit for a in left_bound.tolist() for b in right_bound.tolist()]
    found = np.empty(size, dtype=object)
    found[:] = [v * scale for v, scale in zip(whole, scales, strict=True)]
    return found.reshape(len(left_bound), len(right_bound))


def row_products(matrix: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``matrix @ weights`` by columns in order, so that a row's value does not depend on the rows beside it."""
    total = np.zeros(len(matrix))
    for column, weight in zip(matrix.T, weights, strict=True):
        total += column * weight
    return total


def solve(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The solution of a small linear system of floats or fractions, in fractions and rounded once. A singular system is an error."""
    rows = [[Fraction(v) for v in line] + [Fraction(t)] for line, t in zip(matrix.tolist(), target.tolist(), strict=True)]
    n = len(rows)
    for k in range(n):
        pivot = max(range(k, n), key=lambda i: abs(rows[i][k]))
        if not rows[pivot][k]:
            raise np.linalg.LinAlgError("singular matrix")
        rows[k], rows[pivot] = rows[pivot], rows[k]
        for i in range(k + 1, n):
            if rows[i][k]:
                factor = rows[i][k] / rows[k][k]
                rows[i] = [a - factor * b for a, b in zip(rows[i], rows[k], strict=True)]
    found = [Fraction(0)] * n
    for k in reversed(range(n)):
        found[k] = (rows[k][n] - sum(a * x for a, x in zip(rows[k][k + 1:n], found[k + 1:], strict=True))) / rows[k][k]
    return np.array([float(x) for x in found])

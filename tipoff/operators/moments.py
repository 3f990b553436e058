"""Sums of outer products over a whole table.

Every task folds its Arrow batches into one small matrix; Spark adds the
matrices up slot by slot, so only one matrix reaches the driver.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column of vectors of ``width`` numbers as a matrix; anything else is an error."""
    if column.null_count:
        raise ValueError("a vector is null")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"a vector does not have {width} numbers")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a number of a vector is null")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(df: DataFrame, fold: Callable[[pa.RecordBatch], np.ndarray], size: int) -> DataFrame:
    """Add up ``fold(batch)`` (a vector of ``size``) over all rows, as (slot, value)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fold(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["slot", "value"]
        )

    parts = df.mapInArrow(partial, "slot int, value double")
    return parts.groupBy("slot").agg(F.sum("value").alias("value"))


def summed_vector(df: DataFrame, fold: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """``summed`` on the driver; ``size`` numbers whatever the table holds."""
    total = np.zeros(size)
    for row in summed(df, fold, size).collect():
        total[row.slot] = row.value
    return total


def summed_blocks(
    df: DataFrame, fold: Callable[[pa.RecordBatch], np.ndarray], size: int, *, meet: int = 4
) -> np.ndarray:
    """``summed_vector`` for long vectors: whole ones are added up in ``meet`` tasks, whose sums reach the driver.

    With ``meet`` of 0 those of all partitions do, which suits a table of few.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fold(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

    parts = df.mapInArrow(partial, "total binary")
    if meet:
        parts = parts.repartition(meet).mapInArrow(add, "total binary")
    return sum((np.frombuffer(row.total) for row in parts.collect()), np.zeros(size))


def gram_matrix(df: DataFrame, left: str, right: str, widths: tuple[int, int]) -> DataFrame:
    """Sum over rows of left[i] * right[j], as (i, j, value).

    Rows where either vector is null are left out; a vector of another length
    or with a null number is an error.
    """
    rows, columns = widths

    def fold(batch):
        x, y = vectors(batch.column(0), rows), vectors(batch.column(1), columns)
        return (x.T @ y).ravel()

    pair = df.select(
        F.col(left).cast("array<double>").alias("x"), F.col(right).cast("array<double>").alias("y")
    ).where("x IS NOT NULL AND y IS NOT NULL")
    slot = F.col("slot")
    return summed(pair, fold, rows * columns).select(
        F.floor(slot / columns).cast("int").alias("i"), (slot % columns).alias("j"), "value"
    )

"""Group ordinals and one-row-per-group picks."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tipoff.limits import DEFAULT, Limits
from tipoff.operators.ordered import with_position


def group_ordinal(
    df: DataFrame, keys: list[str], out: str,
    *, limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """One row per distinct key with its 0-based rank in key order; null keys get none.

    Few enough keys (by ``row_bound``) to broadcast are ranked in one task.
    """
    named = df.select(*keys).na.drop().distinct()
    if row_bound is not None and row_bound <= limits.broadcast_rows:
        rank = F.row_number().over(Window.orderBy(*keys)) - 1
        return named.withColumn(out, rank.cast("long"))
    return with_position(named, keys, out)


def first_non_null(
    df: DataFrame, keys: list[str], columns: list[str], order: Column
) -> DataFrame:
    """Per key and per column, the first value in ``order`` that is not null."""
    picks = [
        F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns
    ]
    return df.groupBy(*keys).agg(*picks)

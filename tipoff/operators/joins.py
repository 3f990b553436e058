"""Joining facts to a dimension that may be small, large or skewed."""

from pyspark.sql import DataFrame, functions as F

from tipoff.limits import DEFAULT, Limits
from tipoff.operators.ordered import small
from tipoff.session import materialize


def join_dimension(
    facts: DataFrame, dim: DataFrame, on: list[str],
    *, rows: str, spread: str, how: str = "inner",
    limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Equi-join many facts to one dimension row each.

    ``dim`` is broadcast only when counted (or known by ``row_bound``) to fit;
    otherwise both sides are shuffled, and keys whose ``rows`` column says they
    match more than ``limits.match_rows`` facts are spread over several tasks
    by ``spread``. The counts are jobs that run when this is called.
    """
    if row_bound is None or row_bound > limits.broadcast_rows:
        dim = materialize(dim)
        row_bound = dim.count()
    if row_bound <= limits.broadcast_rows:
        return facts.join(F.broadcast(dim.drop(rows)), on, how)
    hot_rows = limits.match_rows
    salts = F.greatest(F.ceil(F.col(rows) / hot_rows), F.lit(1)).cast("int")
    hot = dim.where(F.col(rows) > hot_rows).select(*on, salts.alias("_salts"))
    n = hot.count()  # at most all facts / hot_rows
    if not n:
        return facts.join(dim.drop(rows), on, how)
    salted = (
        facts.join(small(hot, n, limits), on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(rows)
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")

"""Row numbers, running sums and framed windows that stay bounded when a key is hot.

A plain window sorts each key's rows in one task. Keys with more rows than
``limits.group_rows`` are found first (there are at most total / group_rows of
them) and go another, equally exact way: one global sort gives every hot row
its position, positions are cut into blocks of ``block_rows`` rows, and each
block is its own window. Running sums add the totals of earlier blocks; framed
windows see copies of the rows just outside their block. ``row_bound``, where
the caller knows how many rows there can be at all, may rule hot keys out
without a search; otherwise the search is a job that runs when the operator is
called, and hot rows are written then. A null key is a key like any other.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tipoff.limits import DEFAULT, Limits
from tipoff.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_position(df: DataFrame, order: list, out: str) -> DataFrame:
    """Add the 0-based position in the global sort order, without a one-task window. Sorts and writes when called."""
    tagged = materialize(
        df.orderBy(*order).withColumn("_tag", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_tag", _ROW_BITS))
    # One row per sort partition, a number that is configured, so both the window and the broadcast are bounded.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    row = F.col("_tag").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + row)
        .drop("_part", "_tag", "_offset")
    )


def small(df: DataFrame, rows: int, limits: Limits) -> DataFrame:
    """``df``, known to have at most ``rows`` rows, marked for broadcast if that is few."""
    return F.broadcast(df) if rows <= limits.broadcast_rows else df


def same(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null meets null; the keys of ``other`` go."""
    renamed = other.withColumnsRenamed({c: f"_same_{c}" for c in keys})
    joined = df.join(renamed, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in keys], how)
    return joined.drop(*[f"_same_{c}" for c in keys])


def hot_groups(
    df: DataFrame, keys: list[str], limits: Limits = DEFAULT, row_bound: int | None = None
) -> tuple[DataFrame, int, int] | None:
    """Written keys with more than ``limits.group_rows`` rows, how many they are and how many rows they have; or None."""
    if row_bound is not None and row_bound <= limits.group_rows:
        return None
    seen = Observation()
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limits.group_rows)
    hot = hot.observe(seen, F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows"))
    written = materialize(hot.select(*keys))
    found = seen.get
    return (written, found["keys"], found["rows"]) if found["keys"] else None


def _split(df, keys, limits, row_bound):
    """Rows of other keys, written rows of hot keys (or None), number of hot keys, number of their rows."""
    found = hot_groups(df, keys, limits, row_bound)
    if found is None:
        return df, None, 0, 0
    hot, n, rows = found
    hot = small(hot, n, limits)
    # Written once, because sampling and sorting would each read the source again.
    return same(df, hot, keys, "left_anti"), materialize(same(df, hot, keys, "left_semi")), n, rows


def _hot_rank(df, keys, order, out, n, limits):
    placed = with_position(df, [*keys, *order], "_pos")
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    return (
        same(placed, small(first, n, limits), keys, "inner")
        .withColumn(out, F.col("_pos") - F.col("_first"))
        .drop("_pos", "_first")
    )


def row_rank(
    df: DataFrame, keys: list[str], order: list, out: str,
    *, limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """0-based row number per key."""
    cold, hot, n, _ = _split(df, keys, limits, row_bound)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    result = cold.withColumn(out, plain.cast("long"))
    if hot is None:
        return result
    return result.unionByName(_hot_rank(hot, keys, order, out, n, limits))


def running_sums(
    df: DataFrame, keys: list[str], order: list, value: str, levels: dict[str, list[str]],
    *, limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Inclusive running sums in row frames, one per level; ``order`` must be unique per key.

    ``levels`` maps each output to the keys it adds to ``keys``. All levels
    share one shuffle by ``keys``, and one sort of the keys that are hot.
    """
    cold, hot, n, rows = _split(df, keys, limits, row_bound)

    def add(frame, place, sort):
        for out, extra in levels.items():
            window = Window.partitionBy(*keys, *place, *extra).orderBy(*sort)
            total = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            frame = frame.withColumn(out, total)
        return frame

    result = add(cold, [], order)
    if hot is None:
        return result
    ranked = _hot_rank(hot, keys, order, "_rank", n, limits).withColumn(
        "_block", F.floor(F.col("_rank") / limits.block_rows)
    )
    blocked = add(ranked, ["_block"], ["_rank"])
    for out, extra in levels.items():
        part = [*keys, *extra]
        earlier = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ranked.groupBy(*part, "_block").agg(F.sum(value).alias("_sum")).select(
            *[F.col(c).alias(f"_{c}") for c in (*part, "_block")],
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"),
        )
        if not extra:
            carried = small(carried, rows // limits.block_rows + n, limits)  # one row per block
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*part, "_block")]
        blocked = (
            blocked.join(carried, same)
            .withColumn(out, F.col(out) + F.col("_carry"))
            .drop("_carry", *[f"_{c}" for c in (*part, "_block")])
        )
    return result.unionByName(blocked.drop("_rank", "_block"))


def framed(
    df: DataFrame, keys: list[str], order: list,
    columns: dict[str, Callable[[Window], Column]],
    *, before: int = 0, after: int = 0,
    limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    Each entry of ``columns`` receives the ordered window and returns a column.
    """
    cold, hot, n, _ = _split(df, keys, limits, row_bound)

    def add(frame, window):
        return frame.withColumns({name: make(window) for name, make in columns.items()})

    result = add(cold, Window.partitionBy(*keys).orderBy(*order))
    if hot is None:
        return result
    size = max(limits.block_rows, before, after, 1)
    ranked = _hot_rank(hot, keys, order, "_rank", n, limits).withColumn("_own", F.floor(F.col("_rank") / size))
    place = F.col("_rank") % size
    homes = F.array(
        F.col("_own"),
        F.when(place >= size - before, F.col("_own") + 1),
        F.when((place < after) & (F.col("_own") > 0), F.col("_own") - 1),
    )
    copies = ranked.withColumn("_block", F.explode(F.array_compact(homes)))
    blocked = add(copies, Window.partitionBy(*keys, "_block").orderBy("_rank"))
    return result.unionByName(
        blocked.where(F.col("_block") == F.col("_own")).drop("_rank", "_own", "_block")
    )

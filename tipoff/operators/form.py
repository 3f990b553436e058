"""Rest days, exponentially weighted form and game numbers."""

from pyspark.sql import DataFrame, Window, functions as F

from tipoff.functions.clock import clip
from tipoff.functions.form import block_length, decay_of
from tipoff.limits import DEFAULT, Limits
from tipoff.operators.ordered import framed, row_rank, same
from tipoff.operators.snapshots import running_points
from tipoff.schema import GAME
from tipoff.session import materialize


def days_rest(
    games: DataFrame, entity: str, date: str, *, order: list[str] = (), out: str = "TeamRest",
    cap: int = 4, limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Days since the entity's previous row, 0 for its first, clipped to 0..cap."""
    def gap(window):
        days = F.datediff(date, F.lag(date).over(window))
        return clip(F.coalesce(days, F.lit(0)), 0, cap).cast("int")

    return framed(games, [entity], [date, *order], {out: gap}, before=1, limits=limits, row_bound=row_bound)


def ewm_mean(
    df: DataFrame, values: dict[str, str], keys: list[str], order: list[str],
    *, span: float = 5, include_current: bool = True, limits: Limits = DEFAULT,
    row_bound: int | None = None, block: int | None = None,
) -> DataFrame:
    """Weighted mean of each value over all its key's rows so far; ``values`` maps output to input.

    A row's weight is ``decay`` times that of the next one. A null (or NaN)
    value has no weight but lets the others decay, and shows the mean so far;
    before the first value the mean is null. Without the current row the first
    result is null. ``order`` should be unique per key.

    Rows are cut into blocks (``block`` rows at most) in which plain running
    sums of scaled values do: constant work per row, any span. What earlier
    blocks hand on is summed over blocks by the same rule. Keys with more rows
    than a block are looked for when this is called, unless ``row_bound`` rules
    them out.
    """
    decay = decay_of(span)
    block = block or block_length(decay)
    ranked = row_rank(df, keys, order, "_place", limits=limits, row_bound=row_bound)
    inputs = {}
    for n, value in enumerate(values.values()):
        x = F.col(value).cast("double")
        known = x.isNotNull() & ~F.isnan(x)
        inputs |= {f"_x{n}": F.when(known, x).otherwise(0.0), f"_w{n}": known.cast("double")}
    summed = _decayed_sums(
        ranked.withColumns(inputs), list(inputs), keys, "_place", decay, block, include_current, limits, row_bound
    )
    means = {
        out: F.when(F.col(f"_w{n}_sum") > 0, F.col(f"_x{n}_sum") / F.col(f"_w{n}_sum")) for n, out in enumerate(values)
    }
    return summed.withColumns(means).drop("_place", *inputs, *[f"{c}_sum" for c in inputs])


def _decayed_sums(df, columns, keys, place, decay, block, include_current, limits, row_bound):
    """``<column>_sum``: sum of the values up to a row (or before it), each times decay to the power of its distance.

    All sums of a row may share a factor of ``decay``, which means do not see.
    """
    inside, number = f"{place}_in", f"{place}_block"
    df = df.withColumns({inside: F.col(place) % block, number: F.expr(f"{place} div {block}")})
    end = Window.currentRow if include_current else -1
    window = Window.partitionBy(*keys, number).orderBy(place).rowsBetween(Window.unboundedPreceding, end)
    if decay == 0:  # only the newest value counts; the mean so far is the last one known
        known = {x: F.when(F.col(w) > 0, F.col(x)) for x, w in zip(columns[::2], columns[1::2])}
        newest = last_known(
            df.drop(inside, number).withColumns({f"{x}_known": v for x, v in known.items()}),
            {f"{x}_sum": f"{x}_known" for x in known}, keys, place, block, include_current, row_bound,
        )
        weights = {f"{w}_sum": F.col(f"{x}_sum").isNotNull().cast("double") for x, w in zip(columns[::2], columns[1::2])}
        return newest.withColumns(weights).drop(*[f"{x}_known" for x in known])
    grow, shrink = F.pow(F.lit(1 / decay), F.col(inside)), F.pow(F.lit(decay), F.col(inside))
    sums = {f"{c}_sum": F.coalesce(F.sum(F.col(c) * grow).over(window), F.lit(0.0)) * shrink for c in columns}
    if row_bound is None or row_bound > block:
        df = materialize(df)
        if not df.where(F.col(number) > 0).isEmpty():
            carried = _carried(df, columns, keys, inside, number, decay, block, limits)
            # One row per block, as many as block rows match each: nothing here is hot.
            on = [*keys, number]
            joined = same(df.withColumns(sums), carried, on, "left")
            return joined.withColumns({
                f"{c}_sum": F.col(f"{c}_sum") + F.coalesce(F.col(f"{c}_carry"), F.lit(0.0)) * shrink * decay
                for c in columns
            }).drop(inside, number, *[f"{c}_carry" for c in columns])
    return df.withColumns(sums).drop(inside, number)


def last_known(
    df: DataFrame, values: dict[str, str], keys: list[str], place: str, block: int,
    include_current: bool = True, row_bound: int | None = None,
) -> DataFrame:
    """The last value that is not null, up to each row or before it; ``values`` maps output to input.

    ``place`` is a row's 0-based number in its key. Keys are cut into blocks of
    ``block`` rows, each a window of its own; what a block knows at its end is
    carried on by the same rule over blocks, so no window holds a whole key.
    """
    number = f"{place}_block"
    df = df.withColumn(number, F.expr(f"{place} div {block}"))
    end = Window.currentRow if include_current else -1
    window = Window.partitionBy(*keys, number).orderBy(place).rowsBetween(Window.unboundedPreceding, end)
    within = {out: F.last(value, ignorenulls=True).over(window) for out, value in values.items()}
    if row_bound is not None and row_bound <= block:
        return df.withColumns(within).drop(number)
    df = materialize(df)
    if df.where(F.col(number) > 0).isEmpty():
        return df.withColumns(within).drop(number)
    latest = lambda value: F.max_by(value, F.when(F.col(value).isNotNull(), F.col(place)))
    ends = df.groupBy(*keys, number).agg(*[latest(value).alias(f"{out}_end") for out, value in values.items()])
    carried = last_known(ends, {f"{out}_carry": f"{out}_end" for out in values}, keys, number, max(2, block))
    carried = carried.select(*keys, (F.col(number) + 1).alias(number), *[f"{out}_carry" for out in values])
    # One row per block, as many as block rows match each: nothing here is hot.
    joined = same(df.withColumns(within), carried, [*keys, number], "left")
    return joined.withColumns({out: F.coalesce(out, f"{out}_carry") for out in values}).drop(number, *[f"{out}_carry" for out in values])


def _carried(df, columns, keys, inside, number, decay, block, limits):
    """Per block but a key's first: the decayed sums at the end of the block before it."""
    age = F.pow(F.lit(decay), block - 1 - F.col(inside))
    ends = df.groupBy(*keys, number).agg(*[F.sum(F.col(c) * age).alias(c) for c in columns])
    at_end = decay**block
    blocks = _decayed_sums(
        ends, columns, keys, number, at_end, min(block, max(2, block_length(at_end))), True, limits, None
    ) if at_end > 0 else ends.withColumnsRenamed({c: f"{c}_sum" for c in columns})
    return blocks.select(*keys, (F.col(number) + 1).alias(number), *[F.col(f"{c}_sum").alias(f"{c}_carry") for c in columns])


def player_game_totals(
    plays: DataFrame, statistic: str = "Points",
    *, game: list[str] = GAME, running: bool = False, limits: Limits = DEFAULT,
) -> DataFrame:
    """Each player's largest running total per game.

    Without negative increments that is the sum, and a negative one is an
    error; ``running`` is for statistics that may fall.
    """
    out = f"CumulativePlayer{statistic}"
    if running:
        totals = running_points(plays, statistic, game=game, limits=limits)
        return totals.groupBy("Player", *game).agg(F.max(out).alias(out))
    value = F.col(statistic)
    fail = F.raise_error(F.lit(f"negative {statistic}: use running=True")).cast("long")
    return plays.groupBy("Player", *game).agg(F.sum(F.when(value < 0, fail).otherwise(value)).alias(out))


def player_form(
    totals: DataFrame, statistic: str = "Points",
    *, game: list[str] = GAME, order_by: list[str] | None = None,
    span: float = 5, include_current: bool = True, limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Form by date, and the game number counted in game-id order (or ``order_by``)."""
    source = f"CumulativePlayer{statistic}"
    with_form = ewm_mean(
        totals, {f"RollingAvgPlayer{statistic}": source}, ["Player"], ["Date", *game],
        span=span, include_current=include_current, limits=limits, row_bound=row_bound,
    )
    return row_rank(
        with_form, ["Player"], order_by or game, "PlayerGameNumber", limits=limits, row_bound=row_bound
    )


def team_form(
    games: DataFrame, statistic: str = "Points",
    *, game: list[str] = GAME, team_total: str = "either",
    span: float = 5, include_current: bool = True, limits: Limits = DEFAULT, row_bound: int | None = None,
) -> DataFrame:
    """Scoring and allowed form of both sides, home games and away games apart.

    ``games`` has one row per game with the final ``Home``/``Away`` totals and
    the opponent totals each side saw. ``either`` uses the larger of the two
    sides for both; ``own`` uses each side's own, 0 for one without attempts.
    """
    def totals(side, kind):
        if team_total == "own":
            return F.coalesce(F.col(f"{side}{kind}{statistic}"), F.lit(0))
        return F.greatest(f"Home{kind}{statistic}", f"Away{kind}{statistic}")

    result = games
    for side in ("Home", "Away"):
        result = result.withColumns({
            "_scored": totals(side, "Team"), "_allowed": totals(side, "Opponent"),
        })
        result = ewm_mean(
            result,
            {
                f"RollingAvg{side}Team{statistic}": "_scored",
                f"RollingAvg{side}TeamAllowed{statistic}": "_allowed",
            },
            [f"{side}Team"], ["Date", *game],
            span=span, include_current=include_current, limits=limits, row_bound=row_bound,
        )
    return result.drop("_scored", "_allowed")


def pick_side_form(df: DataFrame, statistic: str = "Points") -> DataFrame:
    """A side's own form, and the allowed form of the side across from it."""
    home = F.col("Home") == 1
    own, allowed = f"RollingAverageTeam{statistic}", f"RollingAverageOpposingTeamAllowed{statistic}"
    return df.withColumns({
        own: F.when(home, F.col(f"RollingAvgHomeTeam{statistic}"))
        .otherwise(F.col(f"RollingAvgAwayTeam{statistic}")),
        allowed: F.when(home, F.col(f"RollingAvgAwayTeamAllowed{statistic}"))
        .otherwise(F.col(f"RollingAvgHomeTeamAllowed{statistic}")),
    })

"""Mixing sources to target token weights by entropy balancing; DataFrame functions only.

Each source has a token target. Among all document rates between 0 and ``cap``
whose tokens meet it, the ones closest to 1 in relative entropy are
``min(cap, exp(multiplier * size))``: the document rates are exponentially
tilted by size, one multiplier per source. The multipliers solve the convex dual,
by Newton steps whose sums Spark aggregates; rates are then rounded into copies.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tipoff.limits import Limits
from tipoff.llm.common import SPACE, Positions, let
from tipoff.operators.joins import join_dimension
from tipoff.operators.ordered import row_rank, running_sums, with_position
from tipoff.session import discard, materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
TOLERANCE = 1e-6  # of a source's target
STEPS = 80  # far beyond what Newton steps in a bracket need
GRID = 1 << 20  # rates are rounded to this grid, so sums do not depend on their order
POINTS = 1 << 8  # the same for sums of tokens
OFFSETS = 32  # starting points of the rounding that are tried
LIMITS = Limits(group_rows=200_000, block_rows=100_000, broadcast_rows=20_000, match_rows=200_000)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null. Equals the number of runs of non-white-space."""
    tidy = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    gaps = let(tidy, lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1))
    return gaps.cast("long")


def source_key(source: Column) -> Column:
    """Non-null text that sorts as the sources do by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def source_targets(cells: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """src, tokens, mean, target: ``share`` of all tokens by weight, the excess over ``cap`` x tokens reshared."""
    sources = cells.groupBy("src").agg(
        F.sum(F.col("size") * F.col("m") * F.col("n")).alias("tokens"), F.sum(F.col("m") * F.col("n")).alias("rows")
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialize(with_position(sources, ["src"], "place").select(
        "src", "tokens", F.greatest(F.col("tokens") / F.col("rows"), F.lit(1.0)).alias("mean"),
        F.get(cycle, (F.col("place") % len(weights)).cast("int")).alias("weight"),
    ))
    goal = share * (sources.agg(F.sum("tokens")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # every round raises the level and may fill more sources
        is_full = F.col("weight") * level >= cap * F.col("tokens")
        if full < 0:
            is_full = F.lit(False)
        row = sources.agg(
            F.sum(F.when(is_full, cap * F.col("tokens")).otherwise(0)).alias("held"),
            F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(is_full, 1)).alias("full"),
        ).first()
        if row.full == full:
            break
        full = row.full
        if not row.open:
            break
        level = (goal - row.held) / row.open
    return sources.select("src", "tokens", "mean", F.least(F.lit(float(cap)) * F.col("tokens"), F.col("weight") * level).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), multiplier * size / mean)))
    return F.when(size == 0, 1.0).when(F.col("target") >= cap * F.col("tokens"), float(cap)).otherwise(tilted)


def multipliers(cells: DataFrame, sources: DataFrame, *, cap=CAP, tolerance=TOLERANCE, limits: Limits = LIMITS) -> DataFrame:
    """``sources`` with the multiplier that meets each target.

    Newton steps, all sources at once; a step that leaves the bracket known so
    far is replaced by its middle. Stops when every source is met.
    """
    size, rows = F.col("size"), F.col("n") * F.col("m")
    state = materialize(sources.withColumns({
        "x": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "met": F.lit(False),
    }))
    for _ in range(STEPS):
        rate = _rate(F.col("x"), size, F.col("mean"), cap)
        points = lambda value: F.sum(F.round(value * POINTS).cast("long")) / POINTS
        joined = join_dimension(cells, state.withColumn("__rows", F.lit(1)), ["src"], rows="__rows", spread="size", limits=limits)
        sums = joined.groupBy("src").agg(
            points(rows * size * rate).alias("got"),
            points(F.when(rate < cap, rows * size * (size / F.col("mean")) * rate).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        settled = (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("target") >= cap * F.col("tokens"))
        low = F.when(gap < 0, F.col("x")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("x")).otherwise(F.col("high"))
        stepped = (
            state.join(sums, "src", "left")
            .withColumns({"low": low, "high": high, "met": F.coalesce(settled, F.lit(True))})
            .withColumn("narrow", F.coalesce(F.col("high") - F.col("low") < 1e-12, F.lit(False)))
            .withColumn("next", F.when(F.col("slope") > 0, F.col("x") - (F.col("got") - F.col("target")) / F.col("slope")))
            .withColumn("far", F.when(F.col("got") < F.col("target"), 1.0).otherwise(-1.0) * (1 + 2 * F.abs("x")) + F.col("x"))
            .withColumn("next", F.when(
                F.col("next").isNotNull() & (F.col("next") > F.coalesce("low", F.lit(-1e9))) & (F.col("next") < F.coalesce("high", F.lit(1e9)))
                & (F.abs(F.col("next") - F.col("x")) <= 1 + 2 * F.abs("x")), F.col("next"),
            ).otherwise(F.coalesce((F.col("low") + F.col("high")) / 2, F.col("far"))))
            .select(*sources.columns, F.when(F.col("met"), F.col("x")).otherwise(F.col("next")).alias("x"), "low", "high", (F.col("met") | F.col("narrow")).alias("met"))
        )
        following = materialize(stepped)
        discard(state)
        state = following
        if state.where(~F.col("met")).isEmpty():
            return state.drop("low", "high", "met")
    raise RuntimeError("multipliers did not settle")


def _rounding(cells: DataFrame, tilted: DataFrame, cap, limits: Limits) -> DataFrame:
    """Cells with their whole copies and the number of units that get one more.

    Fractions are added up over a source's cells in order of size, and a unit
    more is due whenever the sum passes a whole number: tokens then miss the
    target by no more than a large document. Of several starting points the
    one that misses least is taken for each source.
    """
    joined = join_dimension(cells, tilted.withColumn("__rows", F.lit(1)), ["src"], rows="__rows", spread="size", limits=limits)
    grid = F.round(_rate(F.col("x"), F.col("size"), F.col("mean"), cap) * GRID).cast("long")
    joined = joined.withColumn("grid", grid).withColumns({
        "whole": F.expr(f"grid div {GRID}"), "due": F.expr(f"(grid % {GRID}) * n"),
    })
    summed = running_sums(joined, ["src"], ["size", "m"], "due", {"upto": []}, limits=limits)
    offsets = F.transform(F.sequence(F.lit(0), F.lit(OFFSETS - 1)), lambda k: (k * (GRID // OFFSETS)).cast("long"))
    more = F.transform(offsets, lambda o: (
        F.floor((F.col("upto") + o) / F.lit(float(GRID))) - F.floor((F.col("upto") - F.col("due") + o) / F.lit(float(GRID)))
    ).cast("long"))
    summed = materialize(summed.withColumn("more", more))
    words = F.col("size") * F.col("m")
    missed = summed.select("src", "target", F.posexplode("more").alias("k", "extra"), (words * F.col("n") * F.col("whole")).alias("base"), words.alias("words"))
    missed = missed.groupBy("src", "target", "k").agg(F.sum(F.col("base") + F.col("words") * F.col("extra")).alias("got"))
    best = missed.groupBy("src").agg(F.min_by("k", F.struct(F.abs(F.col("got") - F.col("target")), "k")).alias("k"))
    chosen = join_dimension(summed, best.withColumn("__rows", F.lit(1)), ["src"], rows="__rows", spread="size", limits=limits)
    return chosen.select("src", "size", "m", "n", "tokens", "target", "grid", "whole", F.get("more", "k").alias("extra"))


def mix(
    docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", limits: Limits = LIMITS,
) -> DataFrame:
    """One row per distinct (id, source, size): size, source_size, target, rate, copies, taken, rows.

    ``rows`` counts the repeated rows the line stands for; all get the same
    number of copies. Sources by code point, null last, take ``weights`` in
    turn and share ``share`` times all words; no target is above ``cap`` times
    its source, what exceeds that is reshared. copies is 0 to ``cap``; taken =
    copies x size. A text without words (also null) has rate 1. Equal inputs
    give equal results, whatever the partitions: sums are kept in whole numbers
    and ties go by a hash of the id. Texts are read once. Rows are folded by
    (source, size) before sources are summed or solved for, so a hot source
    is a few thousand numbers; sizes that very many rows share are ranked in blocks.
    """
    units = docs.select(
        F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("src"), word_count(F.col(text_col)).alias("size")
    )
    units = materialize(units.groupBy("id", "src", "size").agg(F.count("*").alias("m")))
    cells = materialize(units.groupBy("src", "size", "m").agg(F.count("*").alias("n")))
    tilted = multipliers(cells, source_targets(cells, weights, share, cap), cap=cap, limits=limits)
    rounded = _rounding(cells, tilted, cap, limits)
    keyed = units.withColumn("mark", F.xxhash64("id"))
    ranked = row_rank(keyed, ["src", "size", "m"], ["mark", "id"], "place", limits=limits)
    found = join_dimension(ranked, rounded, ["src", "size", "m"], rows="n", spread="mark", limits=limits)
    copies = (F.col("whole") + (F.col("place") < F.col("extra")).cast("long")).cast("long")
    return found.select(
        F.col("id").alias(id_col), "src", "size", F.col("tokens").alias("source_size"), "target",
        (F.col("grid") / GRID).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), F.col("m").alias("rows"),
    )


def mixed_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", limits: Limits = LIMITS, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (0 to ``cap`` times); all columns stay."""
    own = Positions(docs)
    asked = own.frame.select(own[id_col].alias("id"), own[text_col].alias("text"), own[source_col].alias("source"))
    found = mix(asked, id_col="id", text_col="text", source_col="source", limits=limits, **options)
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    keys = {"id": name(own[id_col]), "src": source_key(own[source_col]), "size": word_count(own[text_col])}
    taken = found.select(name(F.col("id")).alias("id"), "src", "size", "copies", "rows").where(F.col("copies") > 0)
    joined = join_dimension(own.frame.withColumns(keys), taken, [*keys], rows="rows", spread="id", limits=limits)
    return own.restored(joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))

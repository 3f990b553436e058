"""Column statistics, z-scores and histograms."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tipoff.schema import PAYOFF_COLUMNS, STATE


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation per column; a few numbers, kept on the driver."""

    means: dict[str, float]
    deviations: dict[str, float]


def feature_stats(
    df: DataFrame, columns: list[str] = STATE, *, untouched: list[str] = PAYOFF_COLUMNS
) -> DataFrame:
    """(feature, mean, deviation) in one aggregation; ``untouched`` columns get 0 and 1."""
    moments = []
    for c in columns:
        fixed = c in untouched
        value = F.col(c).cast("double")
        moments.append(F.struct(
            F.lit(c).alias("feature"),
            (F.lit(0.0) if fixed else F.avg(value)).alias("mean"),
            (F.lit(1.0) if fixed else F.stddev_pop(value)).alias("deviation"),
        ))
    return df.agg(F.array(*moments).alias("stats")).select(F.inline("stats"))


def fit_scaling(
    df: DataFrame, columns: list[str] = STATE, *, untouched: list[str] = PAYOFF_COLUMNS
) -> Scaling:
    rows = feature_stats(df, columns, untouched=untouched).collect()
    return Scaling({r.feature: r.mean for r in rows}, {r.feature: r.deviation for r in rows})


def z_scores(scaling: Scaling) -> dict[str, Column]:
    """Scaled columns by name; a constant column becomes null."""
    def scaled(c):
        centred = F.col(c).cast("double") - F.lit(scaling.means[c]).cast("double")
        return F.try_divide(centred, F.lit(scaling.deviations[c]).cast("double"))

    return {c: scaled(c) for c in scaling.means}


def standardize(df: DataFrame, scaling: Scaling) -> DataFrame:
    return df.withColumns(z_scores(scaling))


def score_histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between the smallest and largest value, the last one closed; empty bins count 0."""
    spark = df.sparkSession
    low, high = df.agg(F.min(column), F.max(column)).first()
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if low is None:
        return edges.select("bin", F.lit(None).cast("double").alias("left_edge"), F.lit(0).cast("long").alias("rows"))
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("int")
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("rows"))
    )
    return edges.join(F.broadcast(counts), "bin", "left").select(  # at most ``bins`` rows
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("left_edge"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    )

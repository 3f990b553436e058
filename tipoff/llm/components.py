"""Connected components by alternating star contractions."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tipoff.limits import DEFAULT, Limits
from tipoff.operators.joins import join_dimension
from tipoff.session import discard, intermediates, new_path

_ROUNDS = 200  # far beyond the logarithmic number that any graph needs


def components(edges: DataFrame, u: str, v: str, *, limits: Limits = DEFAULT, tasks: int | None = None) -> DataFrame:
    """Rows (node, root) for every node that is on an edge to another; root is the smallest node reachable.

    Each round points the larger neighbours of every node at its smallest one,
    then the smaller ones too, until the edges are stars. Rounds are written,
    so a lost executor costs one round at most; the round before is removed. The
    edges of a node with very many neighbours are spread over tasks. ``tasks``:
    no stage needs more, for callers that know their edges to be few.
    """
    spark = edges.sparkSession
    a, b = F.col(u), F.col(v)
    dealt = lambda rows: rows if tasks is None else rows.coalesce(tasks)
    stars, before = _written(
        spark, lambda: dealt(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    )
    for _ in range(_ROUNDS):
        following, after = _written(spark, lambda: _contracted(stars, 2 * before[0], limits, dealt))
        discard(stars)
        stars = following
        if after == before:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        before = after
    raise RuntimeError("components did not settle")


def _contracted(stars: DataFrame, nodes: int, limits: Limits, dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The edges after a large and a small star step; there are at most ``nodes`` nodes."""
    joined = lambda facts, dim, key, spread: join_dimension(
        facts, dim, [key], rows="degree", spread=spread, limits=limits, row_bound=nodes
    )
    degree = F.count(F.lit(1)).alias("degree")
    both = stars.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(stars.select("lo", "hi"))
    least = dealt(both.groupBy("x").agg(F.min("y").alias("m"), degree)).withColumn("m", F.least("x", "m"))
    large = dealt(joined(both, least, "x", "y").where("y > x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct())
    mins = dealt(large.groupBy("hi").agg(F.min("lo").alias("m"), degree))
    small = joined(large, mins, "hi", "lo").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return dealt(small.union(mins.select("hi", F.col("m").alias("lo"))).distinct())


def _written(spark: SparkSession, build: Callable[[], DataFrame]):
    """The written edges, and their count with a checksum of their content; what joins wrote for them is removed."""
    path, seen = new_path(spark), Observation()
    with intermediates(spark):
        found = build()
        found.observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("hi", "lo")).alias("mark")).write.parquet(path)
    return spark.read.schema(found.schema).parquet(path), (seen.get["rows"], seen.get["mark"])

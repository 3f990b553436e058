"""Raw play logs and processed tables, read with fixed schemas."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tipoff.operators.snapshots import SEQUENCE_LIMIT
from tipoff.schema import FEATURE_TABLE, PLAY_LOG
from tipoff.session import materialize
from tipoff.sources.sorted_table import write_sorted

LINE, REJECTED = "__line", "__rejected"


def read_table(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True, enforceSchema=False) if fmt == "csv" else reader.format(fmt).load(path)


def read_plays(spark: SparkSession, path: str, schema=PLAY_LOG, fmt: str = "csv") -> DataFrame:
    """One raw log. CSV columns are matched by name and must all be there.

    Unreadable numbers are null, and a play without a clock counts in no
    interval; :func:`read_checked` keeps such rows aside while it reads.
    """
    if fmt != "csv":
        return read_table(spark, path, schema, fmt)
    text = spark.read.csv(path, header=True, inferSchema=False)
    _require(path, schema, text.columns)
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Checked:
    """A log read once: its plays, the rows that could not be read, and what was counted on the way."""

    plays: DataFrame
    rejected: DataFrame  # the log's columns as text, and ``bad``: an array of (column, content)
    counts: DataFrame  # column, filled, unreadable; the column "line" counts lines with too few or too many cells
    rows: int
    rejected_rows: int


def read_checked(spark: SparkSession, path: str, schema=PLAY_LOG, *, drop: bool = True) -> Checked:
    """Read a CSV log in one pass that also counts and keeps aside what cannot be read.

    A row with an unreadable number, or from a line with too few or too many
    cells, is rejected: it is written aside as text with the reason, and not
    among the plays (with ``drop`` False it is there too, with nulls). The
    columns are matched by name and must all be there; files must have one
    order of columns. The job runs when this is called; plays and rejected
    rows are read from what it wrote.
    """
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    _require(path, schema, names)
    # All cells are parsed, also of columns that are not used, so that every line's number of cells is seen.
    everything = spark.read.option("columnPruning", False).schema(", ".join([*(f"`{n}` string" for n in names), f"`{LINE}` string"]))
    text = everything.csv(
        path, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE
    )
    numbers = [f for f in schema if f.dataType.typeName() != "string"]
    unread = {f.name: F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull() for f in numbers}
    cell = lambda name, content: F.struct(F.lit(name).alias("column"), content.alias("content"))
    bad = F.array_compact(F.array(
        *[F.when(condition, cell(name, F.col(name))) for name, condition in unread.items()],
        F.when(F.col(LINE).isNotNull(), cell("line", F.col(LINE))),
    ))
    own = [f.name for f in schema]
    sorted_out = text.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema],
        F.when(F.size(bad) > 0, F.struct(*own, bad.alias("bad"))).alias(REJECTED), F.col(LINE),
        *[condition.alias(f"unread_{name}") for name, condition in unread.items()],
    )
    seen = Observation()
    observed = sorted_out.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(REJECTED).alias("rejected"), F.count(LINE).alias("line"),
        *[F.count(f.name).alias(f"read_{f.name}") for f in numbers],
        *[F.count(F.when(F.col(f"unread_{name}"), 1)).alias(f"bad_{name}") for name in unread],
    )
    written = materialize(observed.drop(LINE, *[f"unread_{name}" for name in unread]))
    found = seen.get
    counts = [(name, found[f"read_{name}"] + found[f"bad_{name}"], found[f"bad_{name}"]) for name in unread]
    counts.append(("line", found["rows"], found["line"]))
    plays = (written.where(F.col(REJECTED).isNull()) if drop else written).drop(REJECTED)
    return Checked(
        plays, written.where(F.col(REJECTED).isNotNull()).select(f"{REJECTED}.*"),
        spark.createDataFrame(counts, "column string, filled long, unreadable long"), found["rows"], found["rejected"],
    )


def unreadable(spark: SparkSession, path: str, schema=PLAY_LOG) -> DataFrame:
    """Per column that is there and not text: rows of the CSV log with content, and those whose content cannot be read."""
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    own = T.StructType([f for f in schema if f.name in names])
    return read_checked(spark, path, own).counts.where(F.col("column") != "line")


def _require(path: str, schema, names: list[str]) -> None:
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")


def tag_season(plays: DataFrame, season: int) -> DataFrame:
    return plays.withColumn("Season", F.lit(season))


def union_seasons(seasons: dict[int, DataFrame]) -> DataFrame:
    """All seasons, rows kept as they are, columns matched by name."""
    tagged = [tag_season(plays, season) for season, plays in seasons.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def add_sequence(plays: DataFrame) -> DataFrame:
    """A repeatable tie-breaker for logs without a play number, from the row's own content."""
    content = F.xxhash64(*plays.columns)
    return plays.withColumn("PlaySeq", F.pmod(content, F.lit(SEQUENCE_LIMIT)))


def load_plays(spark: SparkSession, paths: dict[int, str], schema=PLAY_LOG, fmt: str = "csv") -> DataFrame:
    """Read one log per season, tag, union and number the plays."""
    return add_sequence(union_seasons({s: read_plays(spark, p, schema, fmt) for s, p in paths.items()}))


def write_features(features: DataFrame, path: str, fmt: str = "csv", *, ordered: bool = False) -> None:
    """The feature table's columns; ``ordered`` by player, game and interval within and across files."""
    _write(features.select(*FEATURE_TABLE.fieldNames()), path, fmt, ordered)


def _write(rows: DataFrame, path: str, fmt: str, ordered: bool) -> None:
    if ordered:
        write_sorted(rows, path, fmt=fmt)
    else:
        rows.write.csv(path, header=True) if fmt == "csv" else rows.write.format(fmt).save(path)


def read_features(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, FEATURE_TABLE, fmt)


def write_scores(scored: DataFrame, path: str, fmt: str = "csv", *, ordered: bool = False) -> None:
    """Scored rows with their keys, which take the place of a row number; ``ordered`` by them within and across files."""
    _write(scored, path, fmt, ordered)

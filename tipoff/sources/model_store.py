"""Trained networks as versioned tables: parameters, the statistics they were trained with, and how training ended.

A version is one folder, ``version=N``, complete once Spark's success mark is
there; half-written ones are passed over. Training progress is kept the same
way, one folder per evaluation, so that training goes on after the driver is
lost. Tables are small: one row per number of the model.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tipoff.operators.scaling import Scaling

SCHEMA = "part string, place int, name string, value double"


@dataclass(frozen=True)
class Model:
    theta: np.ndarray
    scaling: Scaling
    facts: dict[str, float] = field(default_factory=dict)
    version: int | None = None


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete folders ``kind=N`` below ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = []
    for status in files.listStatus(place):
        name = status.getPath().getName()
        mark = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(f"{kind}=") and files.exists(mark):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def _write(spark: SparkSession, path: str, kind: str, number: int, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{kind}={number}")


def _read(spark: SparkSession, path: str, kind: str, number: int) -> dict[str, list]:
    """Rows of each part, in order."""
    parts: dict[str, list] = {}
    for row in spark.read.schema(SCHEMA).parquet(f"{path}/{kind}={number}").collect():
        parts.setdefault(row.part, []).append(row)
    return {part: sorted(rows, key=lambda r: r.place) for part, rows in parts.items()}


def _rows(part: str, values, names=None) -> list[tuple]:
    names = names or [None] * len(values)
    return [(part, i, name, float(value)) for i, (name, value) in enumerate(zip(names, values, strict=True))]


def versions(spark: SparkSession, path: str) -> list[int]:
    return _folders(spark, path, "version")


def save_model(spark: SparkSession, path: str, theta: np.ndarray, scaling: Scaling, facts: dict[str, float] | None = None) -> int:
    """Write the next version and return its number. One writer at a time."""
    number = max(versions(spark, path), default=0) + 1
    facts = facts or {}
    _write(spark, path, "version", number, [
        *_rows("theta", theta), *_rows("mean", list(scaling.means.values()), list(scaling.means)),
        *_rows("deviation", list(scaling.deviations.values()), list(scaling.deviations)),
        *_rows("fact", list(facts.values()), list(facts)),
    ])
    return number


def load_model(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """A version, or the newest one that is complete."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"{path} has no version {'' if version is None else version}".rstrip())
    number = known[-1] if version is None else version
    parts = _read(spark, path, "version", number)
    named = lambda part: {r.name: r.value for r in parts.get(part, [])}
    return Model(np.array([r.value for r in parts["theta"]]), Scaling(named("mean"), named("deviation")), named("fact"), number)


def model_table(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


class Progress:
    """Where training stands, one folder per evaluation; the last two are kept."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def save(self, step: int, numbers: dict[str, list[float]]) -> None:
        if self.path is None:
            return
        _write(self.spark, self.path, "step", step, [row for part, values in numbers.items() for row in _rows(part, values)])
        for old in _folders(self.spark, self.path, "step")[:-2]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/step={old}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def last(self) -> dict[str, list[float]] | None:
        """The numbers of the last complete step, if there is one."""
        steps = [] if self.path is None else _folders(self.spark, self.path, "step")
        if not steps:
            return None
        return {part: [r.value for r in rows] for part, rows in _read(self.spark, self.path, "step", steps[-1]).items()}

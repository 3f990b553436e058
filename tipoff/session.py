"""Session for tests and the benchmark, and the shared folder for written tables."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(app: str = "tipoff", cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # One session runs many different plans; keep their compiled code.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Recording Python call sites for error messages doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder and folder.startswith("file:") and not context.master.startswith("local"):
        raise ValueError(f"{folder} is a folder of one machine; set spark.checkpoint.dir to one every executor can reach")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tipoff-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_scopes: list[list[str]] = []  # paths written inside each open scope


def new_path(spark: SparkSession) -> str:
    """A fresh path for an intermediate table; the innermost open scope owns it."""
    path = f"{shared_folder(spark)}/tipoff/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession):
    """Removes, when it ends, every intermediate table written inside.

    Results are lazy and read those tables, so use them up inside:

        with intermediates(spark):
            build_features(log).write.parquet(target)

    Outside any scope the tables stay until they are removed by hand.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    Cuts lineage, survives lost executors, and gives the optimizer real sizes.
    The table belongs to the innermost :func:`intermediates` scope.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The written table and its row count, counted by the writing job itself."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return written, seen.get["rows"]


def discard(df: DataFrame) -> None:
    """Remove the table that :func:`materialize` wrote for ``df``, which must not be read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tipoff/" not in path:
            raise ValueError(f"{path} is not an intermediate table")
        _remove(df.sparkSession, path)

"""Tables written in order, with a small table of what each file covers, so that a lookup opens only the files it needs.

Rows are range-partitioned by their keys and sorted, so files cover disjoint
ranges and reading them in name order gives the sorted table. One row per file
(name, rows, first and last keys) is kept beside them; a lookup filters that
table first. Ranges are by all keys: rows of one hot player fill several files.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tipoff.session import materialize_counted

KEYS = ["Player", "GameId", "Interval"]
FILE_ROWS = 2_000_000


def ranges_path(path: str) -> str:
    return f"{path.rstrip('/')}.ranges"


def write_sorted(
    df: DataFrame, path: str, keys: list[str] = KEYS, *, file_rows: int = FILE_ROWS, fmt: str = "parquet", ranges: bool = True
) -> DataFrame:
    """Write ``df`` in files of about ``file_rows`` rows, ordered by ``keys`` (nulls first) within and across files.

    Returns the written table of ranges (none with ``ranges`` False): file,
    rows, first, last, at ``ranges_path(path)``. The rows are written once
    before, because finding the ranges and dealing them out both read them.
    """
    rows, n = materialize_counted(df)
    files = max(1, -(-n // file_rows))
    ordered = rows.repartitionByRange(files, *keys) if files > 1 else rows.repartition(1)
    ordered = ordered.sortWithinPartitions(*keys)
    # Text formats write the header option; others do not know it.
    writer = ordered.write.option("header", True) if fmt == "csv" else ordered.write
    writer.format(fmt).save(path)
    if not ranges:
        return None
    spark = df.sparkSession
    key = F.struct(*keys)
    covered = read_sorted(spark, path, rows.schema, fmt).select(*keys, F.col("_metadata.file_name").alias("file")).groupBy("file").agg(
        F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last")
    )
    covered.coalesce(1).write.parquet(ranges_path(path))  # one row per file
    return spark.read.schema(covered.schema).parquet(ranges_path(path))


def read_sorted(spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def lookup(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **equal) -> DataFrame:
    """Rows whose columns have the given values, from the files whose range can hold them.

    Files are ruled out by the leading keys that are given; all conditions are
    pushed into the scan of the others, where statistics of row groups rule out
    more. The names of the files that may hold the rows are fetched: for a point
    lookup one or two. None is looked for as null.
    """
    covered = spark.read.parquet(ranges_path(path))
    names = covered.schema["first"].dataType.fieldNames()
    lead = names[:next((i for i, c in enumerate(names) if c not in equal), len(names))]
    kinds = {f.name: f.dataType for f in covered.schema["first"].dataType}
    if lead:
        at = F.struct(*[F.lit(equal[c]).cast(kinds[c]).alias(c) for c in lead])
        edge = lambda end: F.struct(*[F.col(end)[c].alias(c) for c in lead])
        covered = covered.where((edge("first") <= at) & (edge("last") >= at))
    files = [f"{path.rstrip('/')}/{r.file}" for r in covered.select("file").collect()]
    found = read_sorted(spark, files, schema, fmt) if files else spark.createDataFrame([], schema)
    same = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in equal.items()]
    return found.where(reduce(lambda a, b: a & b, same)) if same else found


def file_positions(spark: SparkSession, path: str, schema: T.StructType, out: str = "position") -> DataFrame:
    """Every row of a parquet table with its 0-based place when files are read in name order.

    Places follow from the row number in the file and the rows of earlier
    files; no row is sorted or moved.
    """
    rows = spark.read.schema(schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, as small as a file listing
    offsets = spark.read.parquet(ranges_path(path)).select(
        F.col("file").alias("_file"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_offset")
    )
    return rows.join(F.broadcast(offsets), "_file").withColumn(out, F.col("_offset") + F.col("_row")).drop("_file", "_row", "_offset")

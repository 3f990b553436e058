"""Awkward rows that every operator must take, and the driver's tables."""

import os

from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
present = os.path.isdir(FOLDER)

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000)) + "\n" + "x" * 200_000

ODD = [
    None, "", " \n\t ", "one", "two words", "three short words", "a b c d e " * 30, "line\nline\nline\n\nline",
    "Ünïcode – “quotes” 日本語 \U0001f600 text", "non breaking spaces\x85here", "<|endoftext|> inside <|endoftext|>text",
    "UPPER lower MiXeD", "tab\tand\x0bvt\x0cff\rcr", LONG, "tail  spaces   ", "\n\n\n",
]


def documents(spark, texts=ODD, sources=("a", None, "b"), extra=False):
    """Every text twice with the same id (repeated rows), sources in turn."""
    rows = [(i, t, None, sources[i % len(sources)], None) for i, t in enumerate(texts) for _ in range(2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    if not extra:
        return frame
    from pyspark.sql import functions as F

    clash = ["id", "score", "key", "n", "h", "range", "start", "size", "target", "fingerprint", "n_words", "rate", "value", "w"]
    return frame.withColumns({c: F.lit("clash") for c in clash})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(frame, names):
    """``frame`` with more columns of the given names, which may be its own but for their case."""
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit("clash").alias(f"extra{i}") for i in range(len(names))]).toDF(*frame.columns, *names)

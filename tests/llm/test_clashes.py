"""Operators that keep documents, with extra columns named like their own: reserved, dotted, or alike but for case."""

import pytest
from pyspark.sql import functions as F

from tests.llm.texts import ODD, documents
from tipoff.llm import line_dedup, mixing, quality_gam, site_lines
from tipoff.llm.common import Positions

NAMES = [
    "__text", "__row", "__site", "__page", "__copies", "__dropped", "__id", "__mark", "__src", "__size", "__rows", "__copy", "__hashes",
    "c0", "c7", "id", "mark", "text_", "src", "size", "rows", "copies", "copy", "h", "a.b", "DOC_ID", "Text", "x", "page", "dropped",
]


def named(frame):
    """``frame`` with a column of every such name; each holds its own name and the id."""
    extra = [F.concat_ws("/", F.lit(n), F.col("doc_id").cast("string")) for n in NAMES]
    wide = frame.select("*", *[c.alias(f"extra{i}") for i, c in enumerate(extra)])
    return wide.toDF(*frame.columns, *NAMES)


def same_extras(rows, columns):
    assert rows.columns == columns
    for row in rows.collect():
        values = list(row)
        for name, value in zip(columns[5:], values[5:]):
            assert value == "/".join([name, *([] if values[0] is None else [str(values[0])])])


def stages(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD))], "doc_id long, quality int, toxic int")
    yield "quality", lambda docs: quality_gam.keep_good(docs, labels, threshold=0.0)
    yield "lines", line_dedup.drop_boilerplate
    yield "mixing", mixing.mixed_documents


def test_extra_columns_come_out_unchanged(spark):
    docs = named(documents(spark, ODD))
    for name, stage in stages(spark):
        found = stage(docs)
        same_extras(found, docs.columns)
        assert found.count() > 0, name


def test_lines_joined_instead_of_broadcast(spark):
    from tipoff.limits import Limits

    docs = named(documents(spark, ["shared\nown line %d" % i for i in range(12)], sources=("a",)))
    found = line_dedup.drop_boilerplate(docs, limits=Limits(broadcast_rows=0, match_rows=3))
    same_extras(found, docs.columns)
    assert sorted(r[1] for r in found.collect()) == sorted(f"own line {i}" for i in range(12) for _ in range(2))
    assert site_lines.LIMITS.broadcast_rows > 0


def test_positions_give_names_back(spark):
    docs = named(documents(spark, ["one", None]))
    own = Positions(docs)
    assert own.restored(own.frame).collect() == docs.collect()
    assert [r[1] for r in own.restored(own.frame, text=F.lit("new")).collect()] == ["new"] * 4
    with pytest.raises(ValueError):
        own["missing"]

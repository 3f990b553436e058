"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

import public_tokenizers
from pyspark.sql import functions as F

from tipoff.limits import Limits
from tipoff.llm import line_dedup, mixing, packing, quality_gam, simhash
from tipoff.llm.common import Positions, table
from tipoff.llm.queries import MAX_BITS, SEQUENCE, SHINGLE, VOCABULARY
from tipoff.operators.joins import join_dimension
from tipoff.session import materialize, new_path

# Ids of up to this many documents are broadcast (a counted number); beyond, texts are shuffled to them.
LIMITS = Limits(group_rows=200_000, block_rows=100_000, broadcast_rows=500_000, match_rows=200_000)

# No SQL expresses the classifier and the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    """Documents without their site's boilerplate lines."""
    return line_dedup.drop_boilerplate(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash group: the one with the smallest id, and of its repeated rows one.

    A document without an id goes by a negative number made from its text.
    """
    own = Positions(docs)
    mark = F.xxhash64(F.coalesce(own["text"], F.lit("")))
    marked = own.frame.withColumns({"mark": mark, "text": own["text"]}).withColumn(
        "id", F.coalesce(own["doc_id"], -1 - F.shiftrightunsigned("mark", 1))
    )
    found = simhash.near_duplicates(
        marked, shingle=SHINGLE, max_bits=MAX_BITS, id_col="id", keep=("mark",), limits=LIMITS
    )
    first = found.groupBy("component_id").agg(
        F.min(F.struct(F.col("id") != F.col("component_id"), "id", "mark")).alias("first")
    )
    first = first.select(F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    kept = materialize(first.withColumn("rows", F.lit(1)))
    repeated = marked.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    chosen = join_dimension(marked, kept, ["id", "mark"], rows="rows", spread="id", limits=LIMITS)
    if not repeated.isEmpty():
        chosen = chosen.dropDuplicates(["id", "mark"])
    return own.restored(chosen)


def mixture(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs, limits=LIMITS)


def sequences(spark, docs, sf_dir):
    """Pieces of documents in training sequences, with their token ids."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), length=SEQUENCE, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("source mixing", mixture),
    ("packing", sequences),
]


def run(spark, sf_dir):
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

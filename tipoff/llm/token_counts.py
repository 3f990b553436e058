"""Token counts of whole documents, huge ones by resynchronised overlapping chunks."""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tipoff.llm.encoding import CHUNK, OVERLAP, Encoder, read_vocabulary

ROWS = 500  # rows encoded at a time


def token_counts(
    docs: DataFrame, vocabulary: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Texts longer than ``chunk`` characters are encoded in chunks that overlap
    by ``overlap`` and joined at places where a token begins in any context;
    overlaps widen until there is one. A vocabulary without such places is
    applied to whole texts. A null text counts as an empty one: 0 bytes, 0
    tokens. Every input row gives one row, repeated rows too; other columns are
    ignored. Narrow: no shuffle. The vocabulary file is shipped with the tasks.
    """
    kind, content = read_vocabulary(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary file: a few MB

    def count(batches):
        encoder = Encoder(kind, shipped.value)
        for batch in batches:
            sizes = []
            for at in range(0, batch.num_rows, ROWS):
                sizes += map(len, encoder.ids(batch.column(1).slice(at, ROWS).to_pylist(), chunk, overlap))
            counts = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind_of_id = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind_of_id}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

"""Packing neighbouring documents into training sequences along a Hilbert curve."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tipoff.llm.encoding import Encoder, read_vocabulary
from tipoff.session import materialize

BUCKETS = 256  # length of a hashed document vector
DIMENSIONS = 3
BITS = 16  # per dimension of the curve
SEED = 20
ROWS_OUT = 500  # rows of a batch handed to Spark


def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Orthonormal directions, the same in every task."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, dimensions)))[0]


def document_vector(ids: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of hashed token counts, at unit length (zero for no tokens)."""
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(16)) % np.uint64(buckets)
    vector = np.sqrt(np.bincount(hashed.astype(np.int64), minlength=buckets))
    norm = np.sqrt(vector @ vector)
    return vector / norm if norm else vector


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (integers below 2**bits), as int64.

    The curve's cells are turned by reflecting and exchanging axes from the
    coarsest bit down; a Gray code then orders the corners of each cell.
    """
    axes = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for k in range(len(axes)):
            upper = (axes[k] & bit) > 0
            swap = np.where(upper, np.uint64(0), (axes[0] ^ axes[k]) & below)
            axes[0] = np.where(upper, axes[0] ^ below, axes[0] ^ swap)
            axes[k] = axes[k] ^ swap if k else axes[0]
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    flip = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        flip = np.where((axes[-1] & bit) > 0, flip ^ np.uint64((1 << level) - 1), flip)
    axes = [a ^ flip for a in axes]
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << one) | ((a >> np.uint64(level)) & one)
    return key.astype(np.int64)


class Packer:
    """Fills sequences of ``length`` ids from a stream of documents; what is left becomes powers of two."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.held: list = []  # (document, start, ids, tokens of the document) of the open sequence
        self.filled = 0

    def add(self, document, ids: np.ndarray):
        """Pieces of the sequences that this document completes."""
        start = 0
        while start < len(ids):
            part = ids[start:start + self.length - self.filled]
            self.held.append((document, start, part, len(ids)))
            self.filled += len(part)
            start += len(part)
            if self.filled == self.length:
                yield from self._emit(self.held)
                self.held, self.filled = [], 0

    def finish(self):
        """The open sequence, cut into sequences whose lengths are powers of two and need no padding."""
        rest, left = self.held, self.filled
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            taken, kept = [], []
            for document, start, ids, total in rest:
                head, tail = ids[:room], ids[room:]
                room -= len(head)
                if len(head):
                    taken.append((document, start, head, total))
                if len(tail):
                    kept.append((document, start + len(head), tail, total))
            yield from self._emit(taken)
            rest = kept
        self.held, self.filled = [], 0

    def _emit(self, pieces):
        offset = 0
        for document, start, ids, total in pieces:
            content = ids.tobytes()
            yield document, start, len(ids), zlib.crc32(content), total, self.sequence, offset, content
            offset += len(ids)
        self.sequence += 1


def tokenized(docs: DataFrame, vocabulary: str, *, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Written table of id, ids (with the end id) and the curve's key, and the numpy type of the ids.

    Ids are kept in two bytes where the vocabulary allows.
    """
    kind, content = read_vocabulary(vocabulary)
    width = "<u2" if max(Encoder(kind, content).size, end_id + 1) <= 1 << 16 else "<u4"
    shipped = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary file: a few MB

    def encode(batches):
        encoder, directions = Encoder(kind, shipped.value), projection()
        top = (1 << BITS) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                found = [np.array([*x, end_id], dtype=width) for x in encoder.ids(part.column(1).to_pylist())]
                vectors = np.array([document_vector(x[:-1]) for x in found])
                cells = np.clip((vectors @ directions + 1) * 0.5 * top, 0, top).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in found], pa.binary()),
                     pa.array(hilbert_key(cells))], ["id", "ids", "key"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids binary, key long"
    return materialize(rows.mapInArrow(encode, schema)), width


def pack(
    docs: DataFrame, vocabulary: str, *, length: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` ids.

    Documents (token ids, then ``end_id``) are range-sorted by the Hilbert key
    of their projected vectors, ties by id, and cut freely along the curve, so
    every sequence is full but for the end of each range, which is cut into
    sequences of power-of-two length: no id is padding. ``with_ids`` adds the
    ids themselves (binary). A null or empty text is a document of the end id
    alone. Repeated rows are packed as often as they occur; other columns are
    ignored. Texts are encoded once and written; the encoded rows are shuffled
    once, by range of (key, id), so copies spread over many tasks. A task holds
    one batch of rows and one open sequence.
    """
    spark = docs.sparkSession
    rows, width = tokenized(docs, vocabulary, end_id=end_id, id_col=id_col, text_col=text_col)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, "key", "id").sortWithinPartitions("key", "id")
    ordered = ordered.select("id", "ids", F.spark_partition_id().cast("long").alias("range"))
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [rows.schema["id"].dataType.simpleString(), *["long"] * len(columns), "binary"]
    names = ["id", *columns, "ids"] if with_ids else ["id", *columns]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))

    def fill(batches):
        packer, kind = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if packer is None:
                packer, kind = Packer(length, batch.column(2)[0].as_py() << 40), batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS_OUT):
                part, pieces = batch.slice(at, ROWS_OUT), []
                for document, ids in zip(part.column(0).to_pylist(), part.column(1)):
                    pieces += packer.add(document, np.frombuffer(ids.as_buffer(), dtype=width).astype("<u4"))
                yield _pieces(pieces, names, kind)
        if packer is not None:
            yield _pieces(list(packer.finish()), names, kind)

    return ordered.mapInArrow(fill, schema).withColumnRenamed("id", id_col)


def _pieces(pieces, names, kind):
    columns = list(zip(*pieces)) or [[]] * len(names)
    kinds = [kind, *[pa.int64()] * 6, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:len(names)], kinds)], names)

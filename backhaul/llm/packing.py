"""Power-of-two decomposition: documents become pieces of binary lengths, bucketed by length.

A document's ids are cut from the left into pieces of `sequence` ids while so many are left, then
into one piece per set bit of the rest, largest first. Every piece is a training sequence of its
own: no sequence holds two documents, and no sequence needs padding, since batches take sequences
of one bucket. Nothing is shuffled; each input row is encoded and cut where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.llm.encoding import END, encoder, vocabulary_path
from backhaul.llm.words import buffers, slices

SEQUENCE = 4096
OUT = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"


def cut(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of a document of `n` ids; `sequence` is a power of two."""
    rest = n % sequence
    bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return [sequence] * (n // sequence) + bits


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (log2 of the length), the ids
    as little-endian unsigned 32-bit integers, sequence_id and offset (always 0).

    A null or blank text has the end id only, so one piece of length 1; repeated rows and rows
    without an id are packed like any other. Only `doc_id` and `text` are read. An empty table
    gives no rows. A sequence_id is unique within one evaluation of the frame.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end)
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                ids, bounds = encode.encode(*buffers(batch.column(1)))
                tokens = np.diff(bounds)
                pieces = [cut(n, sequence) for n in tokens.tolist()]
                count = np.array([len(p) for p in pieces])
                length = np.concatenate([np.array(p, np.int64) for p in pieces])
                stop = np.cumsum(length)
                begin = stop - length
                row = np.repeat(np.arange(len(count)), count)
                ids = pa.py_buffer(ids.astype("<u4"))
                at = pa.py_buffer(np.concatenate([[0], stop * 4]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)),
                        pa.array(begin - bounds[:-1][row]),
                        pa.array(length),
                        pa.array(tokens[row]),
                        pa.array(np.log2(length).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(length), [None, at, ids]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "bucket", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)
    return rows.withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store the pieces with one folder per bucket, from which batches of one length are read."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )

"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, equal lengths share a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from silovalue.llm import common

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int"
)


def binary_lengths(n: int, context: int) -> list[int]:
    """Whole contexts first, then the set bits of what is left, the largest first: no piece needs padding."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer: str, context: int = 2048, end_id: int = 1, cached: int = common.MAX_CACHED_WORDS,
    at_once: int = common.SLICE_BYTES,
) -> DataFrame:
    """One row per piece, which is a whole sequence of its own: (doc_id, start, length, ids, doc_tokens, sequence_id,
    offset, bucket). ``ids`` are little-endian unsigned 32-bit; ``bucket`` is log2 of the length.

    Every document ends with ``end_id``; a null or empty text is that id alone. Null and repeated doc_ids keep their own
    rows. Columns other than doc_id and text are not read. Nothing is shuffled: a sequence's number is the number of the
    input partition and its place there, so a task that runs again gives the same rows. ``cached`` parts of texts are kept
    encoded in each worker, and about ``at_once`` bytes of text are handled together: fewer take less memory and more time.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            for part in common.slices(batch, limit=at_once):
                rows: list[tuple] = []
                ids = common.tokens(tokenizer, cached).encode(part.column("text"))
                for doc, found in zip(part.column("doc_id").to_pylist(), ids):
                    found, start = np.append(found, np.uint32(end_id)).astype("<u4"), 0
                    data = found.tobytes()
                    for length in binary_lengths(len(found), context):
                        number += 1
                        piece = data[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, piece, len(found), number, 0, length.bit_length() - 1))
                        start += length
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 3, pa.int32()))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per bucket of equal lengths, from which a loader draws batches of as many tokens; no shuffle."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")

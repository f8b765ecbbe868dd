"""Directly addressable codes: token ids split into chunk levels, with continuation bitmaps and rank directories.

The files are a Parquet table of segments, so any store that Spark reaches can hold them. A segment row has the ids of
whole documents in ascending doc_id order. Level 0 has the low ``CHUNK_BITS`` bits of every id; a set bit in a level's
bitmap says that the id goes on in the next level, at the place given by the rank of that bit. The rank directory keeps
the number of set bits before each block of 512, so one id costs a look at one block a level, never a decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from silovalue.llm import common

CHUNK_BITS = 8
BLOCK = 512
SEGMENT_IDS = 1 << 18
SEGMENT = (
    "shard int, segment int, first_token bigint, n_tokens bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)
SEGMENT_ARROW = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
    ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of each level; the last level has no bitmap."""
    rest, chunks, bitmaps, ranks = ids.astype(np.uint32), [], [], []
    while True:
        chunks.append((rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(CHUNK_BITS)
        more = rest > 0
        if not more.any():
            return chunks, bitmaps, ranks
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK))
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4").tobytes())
        rest = rest[more]


class Codes:
    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, dtype=np.uint8) for c in chunks]
        self.bitmaps = [np.frombuffer(b, dtype=np.uint8) for b in bitmaps]
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    def at(self, place: int) -> int:
        """One id: a chunk, a bit and a rank on each level."""
        value = 0
        for level, chunk in enumerate(self.chunks):
            value |= int(chunk[place]) << (CHUNK_BITS * level)
            if level == len(self.bitmaps) or not self.bitmaps[level][place >> 3] >> (place & 7) & 1:
                break
            block = place // BLOCK
            bits = np.unpackbits(self.bitmaps[level][block * BLOCK // 8 : (place >> 3) + 1], bitorder="little")
            place = int(self.ranks[level][block]) + int(bits[: place - block * BLOCK].sum())
        return value

    def all(self) -> np.ndarray:
        values = np.zeros(len(self.chunks[0]), dtype=np.uint32)
        where = np.arange(len(values))
        for level, chunk in enumerate(self.chunks):
            values[where] |= chunk.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if level < len(self.bitmaps):
                where = where[np.unpackbits(self.bitmaps[level], count=len(where), bitorder="little").astype(bool)]
        return values


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, borders: list[int]) -> DataFrame:
    """(doc_id, shard, n_tokens, ids): 16-bit ids where the vocabulary allows, to halve what is shuffled."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batch):
            coder = common.tokens(tokenizer)
            kind = "<u2" if coder.joined.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
            ids = [np.append(x, np.uint32(end_id)) for x in coder.encode(part.column("text"))]
            given = part.column("doc_id").to_pylist()
            shard = [0 if d is None else int(np.searchsorted(borders, d, side="right")) for d in given]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(shard, pa.int32()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], ["doc_id", "shard", "n_tokens", "ids"])

    return common.map_batches(docs, one, "doc_id bigint, shard int, n_tokens bigint, ids binary")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, segment, first = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate([x for _, x in held])
        return pa.RecordBatch.from_pylist([dict(zip(SEGMENT_ARROW.names, (
            shard, segment, first, len(ids), [d for d, _ in held], [len(x) for _, x in held], *encode(ids))))], SEGMENT_ARROW)

    for batch in batches:
        for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
            held.append((doc, np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")))
            size += n
            if size >= SEGMENT_IDS:
                yield close()
                segment, first, size, held = segment + 1, first + size, 0, []
    if held:
        yield close()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shards: int | None = None) -> None:
    """Encodes every text (null: empty), adds ``end_id`` and writes ids in ascending doc_id order, null ids first.

    Rows that share a doc_id are ordered by length and ids. Only ids are shuffled, once, to ranges of doc_id whose
    borders come from a summary of all of them; an empty table gives an empty file set.
    """
    shards = shards or common.width(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    borders = common.range_bounds(given, "doc_id", shards)
    rows = _tokenized(given, tokenizer, end_id, borders).repartitionById(shards, F.col("shard"))
    ordered = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    ordered.mapInArrow(_segments, SEGMENT).write.option("compression", "zstd").parquet(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): ids before each shard. One row per shard, so the running sum is over at most as many rows."""
    totals = spark.read.schema(SEGMENT).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document from the files; ids are little-endian unsigned 32-bit."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()
            ids = Codes(get("chunks"), get("bitmaps"), get("ranks")).all()
            lengths = np.array(get("doc_lengths"), dtype=np.int64)
            ends = np.cumsum(lengths)
            begin = get("base") + get("first_token") + ends - lengths
            data = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(get("doc_ids"), pa.int64()), pa.array(begin), pa.array(lengths),
                pa.array([data[4 * (b - n) : 4 * b] for n, b in zip(lengths.tolist(), ends.tolist())], pa.binary()),
            ], ["doc_id", "start", "n_tokens", "ids"])

    found = spark.read.schema(SEGMENT).parquet(path).join(F.broadcast(directory(spark, path)), "shard")
    return common.map_batches(found, one, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, id) for global places; only the segments that hold a place are opened, and no block is decoded.

    Places outside the files are left out; repeated places give repeated rows.
    """
    import pandas as pd

    segments = spark.read.schema(SEGMENT).parquet(path).join(F.broadcast(directory(spark, path)), "shard").withColumn(
        "begin", F.col("base") + F.col("first_token"))
    spans = segments.select("shard", "segment", "begin", (F.col("begin") + F.col("n_tokens")).alias("end"))
    shard_spans = spans.groupBy("shard").agg(F.min("begin").alias("low"), F.max("end").alias("high"))
    asked = places.select(F.col("place").cast("bigint")).join(
        F.broadcast(shard_spans), F.col("place").between(F.col("low"), F.col("high") - 1)).select("place", "shard")
    asked = asked.join(spans, "shard").where("place >= begin AND place < end").select("shard", "segment", "place").toDF("s", "g", "place")

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"place": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64")})
        row = left.iloc[0]
        coded = Codes(list(row.chunks), list(row.bitmaps), list(row.ranks))
        return pd.DataFrame({"place": right.place, "id": [coded.at(int(p - row.begin)) for p in right.place]})

    return segments.groupBy("shard", "segment").cogroup(asked.groupBy("s", "g")).applyInPandas(
        look, "place bigint, id bigint")


def digest(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

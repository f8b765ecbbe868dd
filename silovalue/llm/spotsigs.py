"""Document fingerprints by SpotSigs: chains of content words that follow common words.

A common word is an anchor; the next content words after it are its chain, and anchor and chain together are hashed to one
signature. A fingerprint is the sorted set of a text's signatures as text, its likeness to another their Jaccard value,
which is not computed further once the set lengths alone rule the wanted likeness out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from silovalue.llm import common

ANCHORS = 400
CHAIN = 2
START = np.uint64(0x5354415254)  # stands for the word before the first one
SIGNATURE = "<u4"
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def bare_words(text: str | None) -> np.ndarray:
    """Hashes of the words without ASCII punctuation."""
    return common.word_hashes(text, MARKS)


def common_words(docs: DataFrame, anchors: int = ANCHORS) -> list[int]:
    """Hashes of the words that are in the most documents of the whole table, ties by hash; counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(bare_words(t)) for t in batch.column(0).to_pylist()]
            keys, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word bigint, n bigint")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(anchors)
    return [r.word for r in top.collect()]


def signatures(words: np.ndarray, anchors: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Sorted set of signatures: one rule for all texts.

    The start of the text is an anchor too, so that every text with words has a signature; a chain that the text's end cuts
    short is as long as it can be. A text of anchors alone has one signature for each of them, one without words has none.
    """
    if not len(words):
        return np.zeros(0, dtype=SIGNATURE)
    place = np.minimum(np.searchsorted(anchors, words), len(anchors) - 1) if len(anchors) else np.zeros(len(words), int)
    anchor = anchors[place] == words if len(anchors) else np.zeros(len(words), bool)
    content = words[~anchor]
    starts = np.concatenate([[0], np.cumsum(~anchor)[anchor]])  # the number of content words before each anchor
    total = common.mixed(np.concatenate([[START], words[anchor]]).astype(np.uint64))
    for j in range(chain):
        there = starts + j < len(content)
        total[there] = common.mixed(total[there] + content[starts[there] + j] * np.uint64(2 * j + 3))
    if len(content):
        total = total[starts < len(content)]
    return np.unique((total >> np.uint64(32)).astype(SIGNATURE))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard value; 1 for two empty sets, and 0 unlooked if the lengths alone keep it under ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def encoded(signature: np.ndarray) -> str:
    return signature.tobytes().hex()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=SIGNATURE)


def fingerprints(docs: DataFrame, anchors: list[int], chain: int = CHAIN) -> DataFrame:
    """(doc_id, n_signatures, fingerprint) of every whole text."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = np.sort(np.array(anchors, dtype=np.int64).view(np.uint64))
        found = [signatures(bare_words(t), known, chain) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([encoded(s) for s in found])], ["doc_id", "n_signatures", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return common.map_batches(rows, one, "doc_id bigint, n_signatures bigint, fingerprint string")


def similar(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, likeness) of different non-empty fingerprints, one pair of representatives for each two; ``a`` and ``b`` are
    the smallest doc_ids of their fingerprints.

    Partitions are length bands: two sets can only be alike if their bands are equal or neighbours. In a band a set is
    listed under its first signatures, of which two alike sets share one; each pair is compared once.
    """
    reps = prints.where("n_signatures > 0 AND doc_id IS NOT NULL").groupBy("fingerprint", "n_signatures").agg(F.min("doc_id").alias("doc_id"))
    reps = common.stored(reps, "spot-reps")
    band = F.floor(F.log(F.col("n_signatures").cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    prefix = (F.col("n_signatures") - F.ceil(least * F.col("n_signatures") - 1e-9) + 1).cast("int")
    first = F.transform(F.sequence(F.lit(0), prefix - 1), lambda i: F.substring("fingerprint", i * 8 + 1, F.lit(8)))
    listed = reps.select("doc_id", band.alias("band"), F.explode(first).alias("key"))
    probe = listed.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).toDF("b", "band", "key")
    pairs = listed.toDF("a", "band", "key").join(probe, ["band", "key"]).where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(reps.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("fa")), "a").join(
        reps.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("fb")), "b")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = [likeness(decoded(x), decoded(y), least) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist())]
        found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(values, pa.float64())], ["a", "b", "likeness"])
        yield found.filter(pa.array([v >= least for v in values], pa.bool_()))

    return common.map_batches(both, one, "a bigint, b bigint, likeness double")


def edited_text(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edit_study(docs: DataFrame, anchors: list[int], chain: int = CHAIN) -> DataFrame:
    """Each document against its edited text and the next one in descending doc_id order, nulls last, the last meeting the
    first: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Texts are shuffled once, to ranges of doc_id; the first text of each range is also sent to the range before it. Rows
    with one doc_id are in order of their text.
    """
    spark, parts = docs.sparkSession, common.width(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    borders = common.range_bounds(rows, "doc_id", parts)
    # Ranges in descending order; null ids make the last.
    below = F.size(F.filter(F.lit(borders).cast("array<bigint>"), lambda x: x <= F.col("doc_id"))) if borders else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), len(borders) + 1).otherwise(len(borders) - below).cast("int")
    placed = rows.withColumn("part", part)
    first_unnamed = F.min(F.when(F.col("doc_id").isNull(), F.col("text")))
    heads = placed.groupBy("part").agg(F.max("doc_id").alias("head"), first_unnamed.alias("text")).orderBy("part").collect()
    before = {h.part: heads[i - 1].part for i, h in enumerate(heads)}  # the first range's head goes to the last range
    if not heads:
        before = {0: 0}
    order = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("part"))
    ids = [h["head"] for h in heads if h["head"] is not None]
    unnamed = [h["text"] for h in heads if h["text"] is not None]
    is_head = F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() & F.col("text").isin(unnamed))
    ahead = placed.where(is_head).withColumn("part", order).withColumn("ahead", F.lit(1))
    dealt = placed.withColumn("ahead", F.lit(0)).unionByName(ahead).repartitionById(len(borders) + 2, F.col("part"))
    sorted_ = dealt.sortWithinPartitions("ahead", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        known = np.sort(np.array(anchors, dtype=np.int64).view(np.uint64))
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last, done = None, False
        for batch in batches:
            out = []
            for doc, text, flag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if done:
                    break
                own = signatures(bare_words(text), known, chain)
                if last is not None:
                    was, before_text, print_ = last
                    changed = edited_text(before_text, text)
                    theirs = signatures(bare_words(changed), known, chain)
                    out.append((was, len(before_text), sha256(changed.encode("utf-8")).hexdigest(), encoded(print_), encoded(theirs),
                                likeness(print_, theirs), likeness(print_, own)))
                done = flag == 1
                last = (doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return sorted_.select("doc_id", "text", "ahead").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

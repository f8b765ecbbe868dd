"""Exact Jaccard join of documents on word shingles.

Any two linked sets share one of their first shingles in a common order (prefix filter), so each document is listed under
its first shingles: a tile is a shingle with the documents listed under it, ordered by set size. Within a tile only sizes
within the ratio meet, where the shingle's places in both orders leave enough to share; a hashed bitmap of each set bounds
the overlap from above by bit counts; what passes is decided by intersecting the sorted arrays of 64-bit shingle hashes. Very
common shingles are moved to the end of the order, and tiles whose documents are connected already are done, so large groups
of copies need no pairs. What counts as common, and from which sizes on tiles are treated as large, changes the work only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from silovalue.functions.lineage import small_side
from silovalue.llm import common

SHINGLE = 5
LEAST = 75  # per cent of the union
LEADERS = 4
DENSE_FROM = 16
DENSE_ROUNDS = 3
MASK_WORDS = 16
MASKED_FROM = 32
COMMON_FROM = 64
MAX_COMMON = 200_000
TILE_BLOCK = 2048
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 28  # of a filter: 16 for each key within these, so at most 32 MB
BITMAP_SLOT = 32_768


def prefix_length(n: np.ndarray | int, least: int):
    """A partner shares at least ceil(least n / 100) of the n shingles, so one of this many first ones."""
    return n - -(-least * n // 100) + 1


def bitmap(hashes: np.ndarray) -> bytes:
    """Bits set at the hashes of the shingles, twice as many places as shingles at least (64 to 65,536)."""
    size = 1 << max(6, min(16, int(2 * len(hashes) - 1).bit_length()))
    bits = np.zeros(size, dtype=np.uint8)
    bits[(hashes >> np.uint64(40)) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def mask(hashes: np.ndarray) -> bytes:
    """A bitmap of the same 1,024 places for every set: many can be compared at once while a tile is searched."""
    bits = np.zeros(64 * MASK_WORDS, dtype=np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(64 * MASK_WORDS)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, n: int, b: bytes, m: int) -> int:
    """No more shingles than this are in both sets: each differing bit is a shingle of one set alone."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):  # the longer one is folded: a place is taken modulo the shorter length
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    differ = int(np.bitwise_count(x ^ y).sum())
    return (n + m - differ) // 2


def linked(common_: int, n: int, m: int, least: int) -> bool:
    return 100 * common_ >= least * (n + m - common_)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
    common.forget_tokens()
    for part in common.slices(batch):
        for doc, hashes in zip(part.column("doc_id").to_pylist(), common.shingles_of(part.column("text").to_pylist(), k)):
            yield doc, common.distinct(hashes)


def summaries(docs: DataFrame, k: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bits, mask, leads, prefix): size, 128-bit fingerprint and bitmaps of the set, its first shingles."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, s in _sets(batch, k):
            data = s.tobytes()
            f1, f2 = (xxhash.xxh3_64_intdigest(data, seed=x) for x in (1, 2)) if len(s) else (0, 0)
            leads = s[: min(LEADERS, prefix_length(len(s), least))] if len(s) else s
            rows.append((doc, len(s), f1 - (1 << 63), f2 - (1 << 63), bitmap(s) if len(s) else b"", mask(s), leads.view(np.int64).tolist(),
                         s[: prefix_length(len(s), least)].tobytes()))
        names = ["doc_id", "n_shingles", "f1", "f2", "bits", "mask", "leads", "prefix"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return common.map_batches(docs, one, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bits binary, mask binary, leads array<bigint>, prefix binary")


def slot_filter(keys: DataFrame, key: str, most: int = MOST_SLOTS) -> bytes:
    """A bit for each slot that holds a key, 16 slots for a key if so many are allowed. False hits are possible only."""
    size = min(most, max(LEAST_SLOTS, 1 << (16 * keys.count()).bit_length()))
    slots = keys.select(F.pmod(F.col(key), F.lit(size)).cast("bigint").alias("s"))
    parts = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    whole = bytearray(size // 8)
    for r in parts:
        if r.b == 0:  # slot 0 alone, which the filter always lets through
            continue
        at = (r.b - 1) * (BITMAP_SLOT // 8)
        whole[at : at + len(r.m)] = r.m[: max(0, len(whole) - at)]
    return bytes(whole)


class Slots:
    """Asks the filter."""

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, dtype=np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        s = np.mod(keys.view(np.int64), 8 * len(self.bits))
        # Position s lies in bucket s // 32768 + 1 (s > 0), bit (s - 1) modulo 32768 by Spark's numbering.
        p = np.maximum(s - 1, 0)
        return ((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool) | (s == 0)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Repeats:
    """Remembers some of the sets that a task has seen, in bounded memory: copies are then mostly listed once, as their class
    edges join them anyway."""

    def __init__(self):
        self.marks = np.zeros(1 << 16, dtype=np.int64)

    def new(self, f1: np.ndarray) -> np.ndarray:
        out = np.zeros(len(f1), dtype=bool)
        for i, mark in enumerate(f1.tolist()):
            at = mark & 0xFFFF
            if self.marks[at] != mark:
                self.marks[at], out[i] = mark, True
        return out


KEY_ROWS = 512  # prefixes unpacked at once


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows whose set the task has not just seen, with their first shingles."""
    repeats = Repeats()
    for batch in batches:
        for a in range(0, batch.num_rows, KEY_ROWS):
            part = batch.slice(a, KEY_ROWS)
            part = part.filter(pa.array(repeats.new(part.column("f1").to_numpy(zero_copy_only=False))))
            yield part, [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in part.column("prefix")]


def plain_keys(sets: DataFrame) -> DataFrame:
    """(key) of all sets' first shingles in the order of hashes, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, prefixes in _prefixes(batches):
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], ["key"])

    return sets.select("f1", "prefix").mapInArrow(run, "key bigint")


def moved_prefixes(docs: DataFrame, sets: DataFrame, heavy: np.ndarray, k: int, least: int) -> DataFrame:
    """(doc_id, n, last, keys) of the documents with a heavy shingle among their first: their first shingles in the order
    with the heavy ones at the end, and the last one of the order of hashes. Only these texts are read again."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, prefixes in _prefixes(batches):
            hit = np.array([among(p, shared.value).any() for p in prefixes], dtype=bool)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(hit))], ["d"])

    ids = common.stored(sets.select("doc_id", "f1", "prefix").mapInArrow(touched, "d bigint"), "join-touched")
    wanted = docs.sparkSession.sparkContext.broadcast(slot_filter(ids, "d"))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = []
        for doc, s in _sets(batch.filter(pa.array(Slots(wanted.value).has(own))), k):
            if doc is None or not len(s):
                continue
            p = prefix_length(len(s), least)
            often = among(s, shared.value)
            if often[:p].any():
                rows.append((doc, len(s), int(s[p - 1].view(np.int64)), np.concatenate([s[~often], s[often]])[:p].tobytes()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n", "last", "keys"])

    return common.map_batches(docs, one, "doc_id bigint, n bigint, last bigint, keys binary")


def brought_keys(moved: DataFrame) -> DataFrame:
    """(key) of the shingles that only the move has brought among the first."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.uint64)]
        for keys, last in zip(batch.column("keys"), batch.column("last").to_numpy(zero_copy_only=False)):
            keys = np.frombuffer(keys.as_buffer(), dtype=np.uint64)
            found.append(keys[keys > last.view(np.uint64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    return common.map_batches(moved.select("keys", "last"), one, "key bigint")


def listing(sets: DataFrame, moved: DataFrame, heavy: np.ndarray, plain: bytes, brought: bytes) -> DataFrame:
    """(key, doc_id, n, place): each set under its first shingles in the order with the heavy ones at the end.

    Keys that no other document can have are left out: a key of the order of hashes stays if it was counted twice there or if
    a move has brought it in somewhere; a key brought in always stays.
    """
    shared = sets.sparkSession.sparkContext.broadcast((heavy, plain, brought))

    def rows(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = zip(*((keys.view(np.int64), np.full(len(keys), doc), np.full(len(keys), n), place) for doc, n, keys, place in found)) if found else ((),) * 4
        flat = [np.concatenate(c).astype(np.int64) if found else np.zeros(0, np.int64) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in flat], ["key", "doc_id", "n", "place"])

    def unmoved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_now, counted, others = shared.value[0], Slots(shared.value[1]), Slots(shared.value[2])
        for part, prefixes in _prefixes(batches):
            found = []
            for doc, n, keys in zip(part.column("doc_id").to_pylist(), part.column("n_shingles").to_pylist(), prefixes):
                if not among(keys, heavy_now).any():
                    place = np.flatnonzero(counted.has(keys) | others.has(keys))
                    found.append((doc, n, keys[place], place))
            yield rows(found)

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, others = Slots(shared.value[1]), Slots(shared.value[2])
        for batch in batches:
            for a in range(0, batch.num_rows, KEY_ROWS):
                part, found = batch.slice(a, KEY_ROWS), []
                for doc, n, last, keys in zip(*(part.column(c) for c in ("doc_id", "n", "last", "keys"))):
                    keys = np.frombuffer(keys.as_buffer(), dtype=np.uint64)
                    late = keys > np.int64(last.as_py()).view(np.uint64)
                    place = np.flatnonzero(counted.has(keys) | others.has(keys) | late)
                    found.append((doc.as_py(), n.as_py(), keys[place], place))
                yield rows(found)

    schema = "key bigint, doc_id bigint, n bigint, place bigint"
    return sets.select("doc_id", "n_shingles", "f1", "prefix").mapInArrow(unmoved, schema).unionByName(moved.mapInArrow(shifted, schema))


def sized_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each tile, rows sorted by tile and size: only sizes within the ratio meet, and other components,
    and places that leave enough, as if the tile's shingle were their first common one; in larger tiles masks must allow it too.

    Rows that can still meet later ones are carried from batch to batch.
    """
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "doc_id", "n", "place", "c", "side")}
        masks = batch.column("mask").to_pylist()
        new["masked"] = np.array([m is not None for m in masks], dtype=bool)
        new["mask"] = np.frombuffer(b"".join(m or bytes(8 * MASK_WORDS) for m in masks), dtype=np.uint64).reshape(-1, MASK_WORDS)
        rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        old = 0 if held is None else len(held["n"])
        total, d = len(rows["n"]), 1
        while d < total:
            later = np.arange(max(d, old), total)
            early = later - d
            meet = (rows["tile"][early] == rows["tile"][later]) & (100 * rows["n"][early] >= least * rows["n"][later])
            if not meet.any():
                break
            hit = meet & (rows["c"][early] != rows["c"][later])
            hit &= (rows["side"][early] != rows["side"][later]) | (rows["side"][later] == 2)
            total_n, most = rows["n"][early] + rows["n"][later], np.minimum((rows["n"] - rows["place"])[early], (rows["n"] - rows["place"])[later])
            hit &= 100 * most >= least * (total_n - most)
            seen = np.flatnonzero(hit & rows["masked"][early])
            if len(seen):
                x, y = early[seen], later[seen]
                both = rows["n"][x] + rows["n"][y]
                most = np.minimum((both - np.bitwise_count(rows["mask"][x] ^ rows["mask"][y]).sum(axis=1)) // 2, rows["n"][x])
                hit[seen] = 100 * most >= least * (both - most)
            if hit.any():
                a, b = rows["doc_id"][early[hit]], rows["doc_id"][later[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            d += 1
        keep = (rows["tile"] == rows["tile"][-1]) & (100 * rows["n"] >= least * rows["n"][-1])
        held = {c: v[keep] for c, v in rows.items()}


def _tiles(listed: DataFrame, slim: DataFrame, block: int) -> DataFrame:
    """(tile, doc_id, n, place, c, side, mask) of tiles with documents of several components; large tiles are cut in pairs of blocks."""
    stats = listed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("rows")).where("c0 < c1")
    stats = common.stored(stats.select("key", "rows"), "join-tiles")
    open_ = listed.join(stats.select("key", "rows"), "key")
    masks = slim.select(F.col("doc_id").alias("d"), "mask").dropDuplicates(["d"])
    large = open_.where(F.col("rows") >= MASKED_FROM).join(masks, F.col("doc_id") == F.col("d")).drop("d")
    open_ = open_.where(F.col("rows") < MASKED_FROM).withColumn("mask", F.lit(None).cast("binary")).unionByName(large)
    blocks = F.ceil(F.col("rows") / block).cast("bigint")
    cut = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    tile = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    # On the diagonal all meet all; elsewhere only the two blocks meet.
    return spread.select(tile.alias("tile"), "doc_id", "n", "place", "c", side.alias("side"), "mask")


def _verified(pairs: DataFrame, docs: DataFrame, slim: DataFrame, k: int, least: int, sets: DataFrame | None = None) -> DataFrame:
    """The stored pairs that are linked: first by the bitmaps' bound, then by the exact intersection.

    Both sides of each join are plain shuffles, so that adaptive execution can split those of a document with many pairs.
    """
    sketch = slim.select("doc_id", "n_shingles", "bits")
    near = pairs.join(sketch.toDF("a", "na", "xa"), "a").join(sketch.toDF("b", "nb", "xb"), "b")

    def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "xa", "xb")]
        keep = [linked(min(overlap_bound(x, n, y, m), n, m), n, m, least) for _, _, n, m, x, y in zip(*columns)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    passed = common.stored(common.map_batches(near, bounded, "a bigint, b bigint"), "join-passed")
    own = common.stored(arrays_of(docs, passed.select(F.explode(F.array("a", "b")).alias("d")), k), "join-arrays") if sets is None else sets
    both = passed.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")

    def exact(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            keep.append(linked(int(among(x, y).sum()), len(x), len(y), least))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = common.stored(common.map_batches(both, exact, "a bigint, b bigint"), "join-links")
    common.discard(passed, *([own] if sets is None else []))
    return links


def arrays_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, s): sorted shingle hashes of the documents with these ids (column d), and of few others at most."""
    wanted = docs.sparkSession.sparkContext.broadcast(slot_filter(ids.distinct(), "d"))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        part = batch.filter(pa.array(Slots(wanted.value).has(own)))
        rows = [(d, s.tobytes()) for d, s in _sets(part, k) if d is not None and len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "s"])

    return common.map_batches(docs, one, "doc_id bigint, s binary")


def dense_links(leads: DataFrame, known: DataFrame, docs: DataFrame, slim: DataFrame, k: int, least: int) -> list[DataFrame]:
    """Links that connect the members of large tiles before any tile is searched through.

    In each round every document of a tile meets one member, another one each time, unless they are connected already.
    That is at most LEADERS pairs a document; the later search is exact whatever is found here.
    """
    large = common.stored(leads.groupBy("key").count().where(F.col("count") >= DENSE_FROM).select("key"), "join-large")
    members = leads.join(large, "key").join(known.toDF("doc_id", "c"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    members = common.stored(members.select("doc_id", "key", "c"), "join-dense")
    if not members.take(1):
        return []
    sets, found = common.stored(arrays_of(docs, members.select(F.col("doc_id").alias("d")), k), "join-dense-sets"), []
    before = members
    for r in range(DENSE_ROUNDS):
        lead = members.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(r), "doc_id").alias("h"), "doc_id", "c")).alias("l"))
        tried = members.join(lead, "key").where("c <> l.c").select(
            F.least("doc_id", "l.doc_id").alias("a"), F.greatest("doc_id", "l.doc_id").alias("b")).distinct()
        new = _verified(tried, docs, slim, k, least, sets)
        if not new.take(1):
            break
        found.append(new)
        label = members.select("doc_id", "c").distinct()
        joined = new.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = common.components(joined).toDF("c", "to")
        members = common.stored(members.join(merged, "c", "left").select("doc_id", "key", F.coalesce("to", "c").alias("c")), "join-dense")
        common.discard(before)
        before = members
    common.discard(sets, before)
    return found


def join(docs: DataFrame, k: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents linked by 100 |A and B| >= least |A or B|.

    Fewer than k words are one shingle; no words or null text: size 0, linked with nothing. Rows that share a doc_id are
    one document of several sets, linked by it. A null doc_id links with nothing and has a null component. Other columns
    are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    whole = common.stored(summaries(docs, k, least), "join-sets")
    usable = whole.where("n_shingles > 0 AND doc_id IS NOT NULL")
    if usable.groupBy("doc_id", "n_shingles", "f1", "f2").count().where("count > 1").take(1):  # each repeated row once from here on
        docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
        usable = common.stored(usable.dropDuplicates(["doc_id", "n_shingles", "f1", "f2"]), "join-distinct")
    slim = usable
    classes = usable.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    same = usable.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"]).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    edges = common.stored(same, "join-same")

    # Most members of large groups share one of their first shingles with the group's smallest member.
    reps = usable.join(edges.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    leads = common.stored(reps.select("doc_id", F.explode("leads").alias("key")), "join-leads")
    # Counts by key are stored before they meet the keys again: adaptive execution can then split a key of very many documents.
    leader = common.stored(leads.groupBy("key").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "join-leaders")
    first = leads.join(leader, "key").where("b < doc_id").groupBy(F.col("doc_id").alias("a")).agg(F.min("b").alias("b"))
    near = _verified(common.stored(first, "join-first"), docs, slim, k, least)
    known = common.components(edges.unionByName(near))
    more = dense_links(leads, known, docs, slim, k, least)
    for links in more:
        near = near.unionByName(links)
    known = common.components(edges.unionByName(near)) if more else known
    common.discard(leads, leader)

    counted = plain_keys(usable).groupBy("key").count().where("count > 1")
    counted = common.stored(counted, "join-keys")
    bounds = counted.where(F.col("count") > COMMON_FROM).orderBy(F.desc("count"), "key").limit(MAX_COMMON)
    heavy = np.sort(np.array([r.key for r in bounds.select("key").collect()], dtype=np.int64).view(np.uint64))
    moved = common.stored(moved_prefixes(docs, usable, heavy, k, least), "join-moved")
    later = common.stored(brought_keys(moved).distinct(), "join-later")
    listed = listing(usable, moved, heavy, slot_filter(counted, "key"), slot_filter(later, "key"))
    listed = listed.join(known.toDF("doc_id", "c"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    listed = common.stored(listed, "join-listed")
    common.discard(counted, later, moved)
    tiles = _tiles(listed, slim, TILE_BLOCK)
    ordered = tiles.repartition(common.width(docs.sparkSession), "tile").sortWithinPartitions("tile", "n", "doc_id")
    pairs = ordered.mapInArrow(lambda b: sized_pairs(b, least), "a bigint, b bigint").where("a <> b").distinct()
    pairs = common.stored(pairs, "join-pairs")
    common.discard(listed)
    found = common.components(edges.unionByName(near).unionByName(_verified(pairs, docs, slim, k, least)))
    common.discard(pairs)
    return whole.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """Documents whose id is their component's; rows without an id stay.

    The ids that go are fewer than those that stay: a measured table of them is broadcast, so that no text is shuffled; a
    larger one is an ordinary join side.
    """
    gone = small_side(joined.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    whole = docs.select(F.struct("*").alias("doc"))
    return whole.join(gone, F.col("doc.doc_id") == F.col("_gone"), "left_anti").select("doc.*")

"""What several corpus operators share: scratch tables, word hashes, fast tokenizing, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from silovalue.functions.lineage import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4_000_000  # text handled at once inside a task
BATCH_SETTING, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
MAX_CACHED_WORDS = 900_000
SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
EDGES_OF_A_TASK = 20_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few MB, unless the session has its own size: two workers of an executor and the
    buffers on both sides hold a multiple of it."""
    if spark.conf.get(BATCH_SETTING, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, "4m")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go as each ends, and not when the driver happens to collect its garbage: for
    queries whose result is stored, so that nothing reads their shuffles again."""
    before = spark.conf.get(SHUFFLE_SETTING, None)
    spark.conf.set(SHUFFLE_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_SETTING)
        else:
            spark.conf.set(SHUFFLE_SETTING, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared scratch folder and read back: later steps don't compute it again, lost executors included."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for table_ in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table_.inputFiles()}:
            path = table_.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table_.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over Arrow batches; those with texts are cut so that a call holds a few MB of them, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch) if "text" in batch.schema.names else (batch,):
                yield from function(part)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(text: str | None, without: bytes = b"") -> np.ndarray:
    """64-bit hash of each word; A-Z are lower-cased, words are runs without space and 0x09-0x0D, and without the given
    bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(None, without).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; fewer words are one run of their own, none give none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        total += mixed(words[j : n - k + 1 + j] + np.uint64(j + 1)) * np.uint64(2 * j + 1)
    return mixed(total + np.uint64(k))


def shingles_of(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """``shingle_hashes`` of the words of each text, the words of all texts hashed in one go."""
    words = [(text or "").encode("utf-8", "surrogatepass").lower().split() for text in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0)
    places = max(0, len(flat) - k + 1)
    total = np.zeros(places, dtype=np.uint64)
    for j in range(k):
        total += mixed(flat[j : j + places] + np.uint64(j + 1)) * np.uint64(2 * j + 1)
    total = mixed(total + np.uint64(k))
    for end, own in zip(ends.tolist(), words):
        n = len(own)
        yield total[end - n : end - k + 1] if n >= k else shingle_hashes(flat[end - n : end], k)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    found = np.sort(hashes)
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


class Tokens:
    """Ids of a public tokenizer for many texts.

    Texts are cut only where the tokenizer's own pre-tokenizer always cuts, before single spaces and between letters and
    ASCII punctuation; each distinct part is encoded by the tokenizers library once and kept in a bounded cache. Texts
    for which the cut is not certain are encoded whole. Where the tokenizer drops spaces and lower-cases, words that differ
    in these only are one part.
    """

    SEPARATOR = "<|endoftext|>"
    LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
    MARKS = r"\n!-&(-/:-@\[-`{-~"  # not the apostrophe, which starts contractions
    UNSURE = r" ([\s\v\x{1c}-\x{1f}\x{85}\p{Z}]|$)"
    COMPOSED = r"[A-Z]\p{M}"  # lower-cased before, it might be composed to another letter

    def __init__(self, path: str, most: int = MAX_CACHED_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.joined = Tokenizer.from_file(path)
        self.separator = self.joined.token_to_id(self.SEPARATOR)
        self.spaces_count, self.most = self.joined.normalizer is None, most
        self.lowers = "Lowercase" in repr(self.joined.normalizer)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts = np.zeros(1 << 16, dtype=np.int64)  # of each part in flat, and the end of the last

    def _learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            text = self.SEPARATOR.join(part) + self.SEPARATOR
            ids = np.array(self.joined.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(ids == self.separator)
            ids = ids[ids != self.separator]
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            first = len(self.known)
            while first + len(part) >= len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.starts[first + 1 : first + 1 + len(part)] = self.used + ends - np.arange(len(ends))
            self.known.update(zip(part, range(first, first + len(part))))
            self.used += len(ids)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.lowers:
            texts = pc.if_else(pc.match_substring_regex(texts, self.COMPOSED), texts, pc.ascii_lower(texts))
        for left, right in ((self.LETTERS, self.MARKS), (self.MARKS, self.LETTERS)):
            texts = pc.replace_substring_regex(texts, f"([{left}])([{right}])", "\\1\x00\\2")
        lists = pc.split_pattern(pc.replace_substring(texts, " ", "\x00 " if self.spaces_count else "\x00"), "\x00")
        words, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self._clear()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        at = slots[coded.indices.to_numpy(zero_copy_only=False)]
        begin = self.starts[at]
        count = self.starts[at + 1] - begin
        ends = np.cumsum(count)
        where = np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[where], np.concatenate([[0], ends])[bounds]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        unsure = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring(texts, "\x00"))
        if self.spaces_count:
            unsure = pc.or_(unsure, pc.match_substring_regex(texts, self.UNSURE))
        sure = np.flatnonzero(~unsure.to_numpy(zero_copy_only=False))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        if len(sure):
            flat, bounds = self._by_words(texts.take(pa.array(sure)))
            for i, a, b in zip(sure, bounds[:-1], bounds[1:]):
                out[i] = flat[a:b]
        self.joined.encode_special_tokens = True  # one tokenizer for both ways: a second one takes as much memory again
        for i in np.flatnonzero(unsure.to_numpy(zero_copy_only=False)):
            found = self.joined.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
            out[i] = np.array(found, dtype=np.uint32)
        self.joined.encode_special_tokens = False
        return out


_LOADED: dict[str, Tokens] = {}


def tokens(path: str, most: int = MAX_CACHED_WORDS) -> Tokens:
    """One tokenizer for each worker process, with at most about ``most`` parts of texts in its cache."""
    if path not in _LOADED:
        _LOADED[path] = Tokens(path, most)
    _LOADED[path].most = most
    return _LOADED[path]


def forget_tokens() -> None:
    """For workers that go on with other work: the tokenizers and what they remember are given back."""
    if _LOADED:
        _LOADED.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 borders that cut the values of an integer column into ranges of about as many rows."""
    wanted = [i / parts for i in range(1, parts)]
    if not wanted:
        return []
    found = df.agg(F.percentile_approx(F.col(column), wanted, max(1000, 10 * parts))).first()[0]
    return sorted(set(found or []))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps: each is one grouping and one join over at most as many edges as there
    were, and the smallest neighbour is found by a map-side combined minimum. The edge table is checkpointed each round,
    in as many tasks as its edges need: a few edges over many partitions would leave mostly files.
    """
    from silovalue.functions.lineage import cut_lineage

    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        with shuffles_dropped(spark):
            table_ = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        return table_, (seen.get["n"], seen.get["h"])

    def star(both: DataFrame, keep) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))

    now, before = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = min(width(spark), before[0] // EDGES_OF_A_TASK + 1)  # there are never more edges than at first
    for _ in range(rounds):
        now = now.coalesce(tasks)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))).coalesce(tasks)
        large = star(both, F.col("v") > F.col("u")).where("a <> b").coalesce(tasks).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).coalesce(tasks)
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").coalesce(tasks).distinct()
        now, state = kept(small.coalesce(tasks))
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

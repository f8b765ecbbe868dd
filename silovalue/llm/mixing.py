"""Mixing sources to target weights by entropy balancing.

Each source shall give a target number of words. Among all document rates that meet the targets, the one nearest to "take
each document once" in relative entropy is an exponential tilt, rate = min(most, exp(slope x size)), with one slope per
source: the solution of a convex dual. Each Newton step is one distributed grouping over counts of (source, size) that
brings two sums per source. Rates become whole copies by one fixed random number per document, shifted per source until
the words taken come near the target; what is still missing goes to single documents. What the driver holds is one row
per source (at most ``MAX_SOURCES``, else it raises), so the last step is a plain pass over the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from silovalue.llm import common

WEIGHTS = (3.0, 1.0, 2.0)
MAX_SOURCES = 200_000
NEWTON_STEPS = 60
TOLERANCE = 1e-6
SHIFTS = 31
SHIFT_ROUNDS = 5
FILL_ROUNDS = 5
STATE = ["_source", "source_size", "target", "slope", "shift", "lack", "extra"]


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(common.WORD)), F.lit(0)).cast("bigint")


def fill_up(sizes: np.ndarray, weights: np.ndarray, share: float, most: int) -> np.ndarray:
    """Targets by weight of ``share`` times all sizes, each at most ``most`` times its size, the rest shared again."""
    total, full = share * float(sizes.sum()), most * sizes.astype(float)
    target, free = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    while free.any():
        left = max(0.0, total - full[~free].sum())
        target[free] = left * weights[free] / weights[free].sum()
        over = free & (target > full)
        if not over.any():
            break
        target[over], free = full[over], free & ~over
    return target


def rate(most: int = 2) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col("slope") * F.col("size")))


def _unit(seed: int) -> Column:
    """A fixed number in [0, 1) for each document and each of its repetitions."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "occurrence"), F.lit(1 << 40)) / F.lit(float(1 << 40))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``occurrence``: 0 for a row of its own, 0, 1, … for rows that share doc_id, source and size.

    Where there are none, nothing is moved. Else the rows are written with the number of their partition and counted inside
    it, and only counts by partition are put in line, so that a row repeated very often is numbered by all tasks.
    """
    keys = ["doc_id", "source", "size"]
    if not rows.groupBy(*keys).count().where("count > 1").take(1):
        return rows.withColumn("occurrence", F.lit(0).cast("bigint"))
    kept = common.stored(rows.withColumn("_part", F.spark_partition_id()), "mix-rows")
    counted = kept.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("n")
    offsets = common.stored(counted.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), before.alias("_before")), "mix-offsets")
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.xxhash64("doc.text"))) - 1
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = kept.withColumn("_inside", inside).join(offsets, same)
    return placed.withColumn("occurrence", (F.col("_before") + F.col("_inside")).cast("bigint")).select(*rows.columns, "occurrence")


def _whole(shift: Column, seed: int, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(0), F.floor(rate(most) + _unit(seed) + shift))).cast("int")


def copies(seed: int = 0, most: int = 2) -> Column:
    more = F.size(F.filter("extra", lambda x: (x["doc_id"] == F.col("doc_id")) & (x["size"] == F.col("size")) & (F.col("occurrence") == 0)))
    return F.least(F.lit(most), _whole(F.col("shift"), seed, most) + F.greatest(more, F.lit(0))).cast("int")


class Plan:
    """Targets, slopes, shifts and extra copies of all sources."""

    def __init__(self, sizes: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int):
        """``sizes``: (doc_id, source, size, occurrence), read several times."""
        self.spark, self.most, self.seed = sizes.sparkSession, most, seed
        hist = common.stored(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
        totals = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s")).limit(MAX_SOURCES + 1).collect()
        if len(totals) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        totals.sort(key=lambda r: (r.source is None, r.source or ""))
        self.names = [r.source for r in totals]
        self.place = {name: i for i, name in enumerate(self.names)}
        self.size = np.array([r.s for r in totals], dtype=np.int64)
        turn = np.array([weights[i % len(weights)] for i in range(len(totals))])
        self.target = fill_up(self.size, turn, share, most)
        self.slope, self.shift = np.zeros(len(totals)), np.full(len(totals), -1.0)
        self.lack = np.zeros(len(totals))
        self.extra: list[list[tuple[int, int]]] = [[] for _ in totals]
        if len(totals):
            self._solve(hist.where("size > 0"))
            self._round(sizes.where("size > 0"))

    def state(self) -> DataFrame:
        pairs = [[{"size": s, "doc_id": d} for s, d in e] for e in self.extra]
        columns = [pa.array(self.names, pa.string()), pa.array(self.size), *map(pa.array, (self.target, self.slope, self.shift, self.lack))]
        kind = pa.list_(pa.struct([("size", pa.int64()), ("doc_id", pa.int64())]))
        return F.broadcast(self.spark.createDataFrame(pa.table([*columns, pa.array(pairs, kind)], names=STATE)))

    def on(self, rows: DataFrame) -> DataFrame:
        """The rows with the state of their source; at most MAX_SOURCES rows are broadcast."""
        return rows.join(self.state(), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    def _sums(self, rows: DataFrame, *columns: Column) -> pd.DataFrame:
        got = self.on(rows).groupBy("source").agg(*columns).collect()
        at = [self.place[r.source] for r in got]
        return pd.DataFrame([tuple(r)[1:] for r in got], index=at, columns=[f"c{j}" for j in range(len(columns))])

    def _solve(self, hist: DataFrame) -> None:
        """Newton on the dual, kept between brackets: the words taken rise with the slope."""
        low, high = np.full(len(self.size), -np.inf), np.full(len(self.size), np.log(self.most))
        self.slope = np.where(self.target >= self.most * self.size, high, 0.0)
        words_taken = F.col("n") * F.col("size") * rate(self.most)
        bend = F.when(rate(self.most) < self.most, words_taken * F.col("size")).otherwise(0.0)
        for _ in range(NEWTON_STEPS):
            sums = self._sums(hist, F.sum(words_taken), F.sum(bend)).reindex(range(len(self.size)), fill_value=0.0)
            off, curve = sums.c0.to_numpy(float) - self.target, sums.c1.to_numpy(float)
            settled = np.abs(off) <= TOLERANCE * np.maximum(self.target, 1.0)
            low, high = np.where(off < 0, self.slope, low), np.where(off > 0, self.slope, high)
            settled |= np.isfinite(low) & (high - low <= 1e-15)
            if settled.all():
                return
            with np.errstate(divide="ignore", invalid="ignore"):
                step = self.slope - off / curve
                rising = np.sqrt(np.maximum(low, 1e-7) * high)
                middle = np.where(low >= 0, rising, np.where(np.isfinite(low), (low + high) / 2, 4 * np.minimum(high, -1e-5)))
            inside = (step < high) & (step > low) & np.isfinite(step)
            self.slope = np.where(settled, self.slope, np.where(inside, step, middle))

    def _round(self, sizes: DataFrame) -> None:
        """Each round tries 31 shifts of every source in one pass and keeps the last that stays at or under the target."""
        gap, taken = np.full(len(self.size), 2.0 / SHIFTS), np.zeros(len(self.size))
        for _ in range(SHIFT_ROUNDS):
            step = float(gap[0])
            tries = [F.sum(F.col("size") * _whole(F.col("shift") + F.lit(j * step), self.seed, self.most)) for j in range(SHIFTS + 1)]
            sums = self._sums(sizes, *tries).reindex(range(len(self.size)), fill_value=0).to_numpy(float)
            fits = np.maximum((sums <= self.target[:, None] + 0.5).sum(axis=1) - 1, 0)
            taken = sums[np.arange(len(sums)), fits]
            self.shift, gap = self.shift + fits * step, gap / SHIFTS
        for _ in range(FILL_ROUNDS):
            self.lack = self.target - taken
            open_rows = self.on(sizes).withColumn("copies", copies(self.seed, self.most))
            first = F.col("doc_id").isNotNull() & (F.col("occurrence") == 0)
            fit = (F.col("size") <= F.col("lack")) & (F.col("copies") < self.most) & first
            picks = open_rows.where(fit).groupBy("source").agg(F.max(F.struct("size", "doc_id")).alias("p")).collect()
            if not picks:
                return
            for r in picks:
                self.extra[self.place[r.source]].append((r.p["size"], r.p["doc_id"]))
                taken[self.place[r.source]] += r.p["size"]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """(doc, size, source_size, target, rate, copies): doc is a struct of the document's own columns, whatever their names.

    Sources by code point, null last, take the weights in turn. Null text or no words: size 0, which takes no words. Rows
    that share doc_id, source and size are numbered, so that each has its own chance and reruns take as many of them; a null
    source is a source of its own; a null doc_id is never used to fill up. An empty table stays empty.
    """
    whole = numbered(docs.select(F.struct("*").alias("doc")).select(
        "doc", F.col("doc.source").cast("string").alias("source"), F.col("doc.doc_id").cast("bigint").alias("doc_id"),
        words("doc.text").alias("size")))
    sizes = common.stored(whole.select("doc_id", "source", "size", "occurrence"), "mix-docs")
    plan = Plan(sizes, weights, share, most, seed)
    return plan.on(whole).select(
        "doc", "size", "source_size", "target", rate(most).alias("rate"), copies(seed, most).alias("copies"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document as many times as it has copies, with its own columns only."""
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select(
        "doc.doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "copies")

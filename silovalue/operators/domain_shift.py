"""How much of a model's loss on another silo comes from a changed relation of label and features.

A domain classifier tells source from target rows by their features; it is cross-fitted, so that no row is judged by a
classifier that has seen it. The logistic classifiers of all silo pairs and folds take each step in one job: tasks add up the
gradients of every pair that a row belongs to, and only those sums are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from silovalue.functions.hashing import fold
from silovalue.functions.lineage import cut_lineage
from silovalue.operators.fit import Models, partial_sums, with_bias
from silovalue.operators.metrics import GLOBAL

MAX_NUMBERS = 20_000_000
FOLDS = 8
STEPS = 12


@dataclass
class Pairs:
    """Which pairs (source, target) a silo's rows belong to, as rows of the table of classifiers."""

    silos: list

    def __post_init__(self):
        self.targets = [*self.silos, GLOBAL]
        self.all = [(s, t) for s in self.silos for t in self.targets]
        place = {pair: i for i, pair in enumerate(self.all)}
        self.as_source = {c: np.array([place[c, t] for t in self.targets]) for c in self.silos}
        self.as_target = {c: np.array([place[s, t] for t in (c, GLOBAL) for s in self.silos]) for c in self.silos}


def shift_rows(df: DataFrame, folds: int = FOLDS, seed: int = 13, id_col: str = "row_id") -> DataFrame:
    """(client_id, fold, features, true): the rows with a silo, a full vector and a target; true is the class position."""
    x, y = F.col("features").cast("array<double>"), F.col("target").cast("array<double>")
    usable = F.col("client_id").isNotNull() & F.col("target").isNotNull() & F.col("features").isNotNull() & F.forall("features", lambda v: v.isNotNull())
    return df.select(
        "client_id", fold(seed, folds, id_col).cast("int").alias("fold"), x.alias("features"),
        (F.array_position(y, F.array_max(y)) - 1).cast("int").alias("true"), "target").where(usable).drop("target")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1, np.exp(-np.abs(z))) / (1 + np.exp(-np.abs(z)))


def fold_products(rows: DataFrame, silos: list, width: int, folds: int) -> dict[object, np.ndarray]:
    """For each silo Σxxᵀ of the rows of each fold, folds × width × width, in one pass."""

    def statistics(_, part: pd.DataFrame) -> np.ndarray:
        x, own = with_bias(np.stack(part["features"].to_numpy())), part["fold"].to_numpy()
        return np.stack([x[own == f].T @ x[own == f] for f in range(folds)]).ravel()

    out = {s: np.zeros(folds * width * width) for s in silos}
    for r in partial_sums(rows, statistics).collect():
        out[r.client_id][r.pos] = r.value
    return {s: v.reshape(folds, width, width) for s, v in out.items()}


def domain_classifiers(rows: DataFrame, pairs: Pairs, width: int, folds: int = FOLDS, steps: int = STEPS, ridge: float = 1e-6) -> np.ndarray:
    """pairs × folds × (features + 1): logistic weights fitted on the rows outside each fold, targets as ones.

    The curvature is replaced by its bound, a quarter of Σxxᵀ, which needs one pass in all and never overshoots; the first
    step from zero is Newton's. So a step shuffles only gradients.
    """
    shape = (len(pairs.all), folds)
    if max(shape[0] * folds * width, len(pairs.silos) * folds * width * width) > MAX_NUMBERS:
        raise ValueError("the classifiers of all pairs are too large for one task")
    by_fold = fold_products(rows, pairs.silos, width, folds)
    outside = {s: v.sum(axis=0) - v for s, v in by_fold.items()}
    outside[GLOBAL] = sum(outside.values())
    bound = np.stack([(outside[s] + outside[t]) / 4 + ridge * np.eye(width) for s, t in pairs.all])
    inverse = np.linalg.pinv(bound, hermitian=True)
    weights = np.zeros((*shape, width))
    for _ in range(steps):
        shipped = rows.sparkSession.sparkContext.broadcast((pairs, weights))

        def statistics(silo, part: pd.DataFrame) -> np.ndarray:
            known, w = shipped.value
            x, own = with_bias(np.stack(part["features"].to_numpy())), part["fold"].to_numpy()
            out = np.zeros((*shape, width))
            unseen = own[:, None] != np.arange(folds)
            for role, members in ((0.0, known.as_source[silo]), (1.0, known.as_target[silo])):
                for pair in members:
                    out[pair] += ((role - _sigmoid(x @ w[pair].T)) * unseen).T @ x
            return out.ravel()

        slope = np.zeros(shape[0] * folds * width)
        for r in partial_sums(rows, statistics).groupBy("pos").agg(F.sum("value").alias("value")).collect():
            slope[r.pos] = r.value
        weights = weights + (inverse @ slope.reshape(*shape, width, 1))[..., 0]
    return weights


def y_shift_features(df: DataFrame, models: Models, folds: int = FOLDS, seed: int = 13, steps: int = STEPS, ridge: float = 1e-6, id_col: str = "row_id") -> DataFrame:
    """(src, tgt, degradation, shared, shift) of every silo against every silo and Global, over all their rows.

    ``df`` is (row id, client_id, features, target); ``models`` has classes × (features + 1) weights of each silo, whose
    accuracy on its own rows and on the target's is compared. Shared-density weights follow from the out-of-fold
    probabilities: ``shared`` is the gap of the accuracies under them, shift its share of the whole degradation, null when the
    accuracies tie. Rows that lack a silo, a vector or a target are left out.
    """
    rows = cut_lineage(shift_rows(df, folds, seed, id_col))
    sizes = {r.client_id: r.n for r in rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).collect() if r.client_id in models}
    rows = rows.where(F.col("client_id").isin(list(sizes)))
    pairs, width = Pairs(sorted(sizes)), next(iter(models.values())).shape[1]
    names = [(str(s), str(t)) for s, t in pairs.all]
    spark = df.sparkSession
    if not sizes:
        return spark.createDataFrame([], "src string, tgt string, degradation double, shared double, shift double")
    weights = domain_classifiers(rows, pairs, width, folds, steps, ridge)
    total = sum(sizes.values())
    alpha = {(s, t): (n := total if t == GLOBAL else sizes[t]) / (sizes[s] + n) for s, t in pairs.all}
    shipped = spark.sparkContext.broadcast((pairs, weights, models, alpha))

    def statistics(silo, part: pd.DataFrame) -> np.ndarray:
        known, w, fitted, share = shipped.value
        x, own, true = with_bias(np.stack(part["features"].to_numpy())), part["fold"].to_numpy(), part["true"].to_numpy()
        out = np.zeros((len(known.all), 8))
        right = {s: ((x @ fitted[s].T).argmax(axis=1) == true).astype(float) for s in known.silos}
        for side, members in ((0, known.as_source[silo]), (4, known.as_target[silo])):
            for pair in members:
                pi = _sigmoid((x * w[pair, own]).sum(axis=1))
                a, hit = share[known.all[pair]], right[known.all[pair][0]]
                weight = (pi if side == 0 else 1 - pi) / ((1 - a) * pi + a * (1 - pi))
                out[pair, side : side + 4] += len(x), hit.sum(), weight.sum(), weight @ hit
        return out.ravel()

    sums = partial_sums(rows, statistics).groupBy(F.floor(F.col("pos") / 8).cast("int").alias("pair")).agg(
        *[F.sum(F.when(F.col("pos") % 8 == i, F.col("value"))).alias(c) for i, c in enumerate(("n_s", "hit_s", "w_s", "wh_s", "n_t", "hit_t", "w_t", "wh_t"))])
    named = F.element_at(F.array(*[F.struct(F.lit(s).alias("src"), F.lit(t).alias("tgt")) for s, t in names]), F.col("pair") + 1)
    gap = F.col("hit_s") / F.col("n_s") - F.col("hit_t") / F.col("n_t")
    shared = F.col("wh_s") / F.col("w_s") - F.col("wh_t") / F.col("w_t")
    return sums.select(named.alias("_p"), gap.alias("degradation"), shared.alias("shared"), F.try_divide(shared, gap).alias("shift")).select(
        "_p.*", "degradation", "shared", "shift")

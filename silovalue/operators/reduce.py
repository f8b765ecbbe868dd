"""Projections to two or three dimensions that show how separable the classes are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from silovalue.functions import arrays
from silovalue.operators.distance import _principal, gramian
from silovalue.operators.fit import partial_sums
from silovalue.operators.metrics import GLOBAL


def _project(df: DataFrame, components: np.ndarray, means: np.ndarray, features: str) -> DataFrame:
    centred = F.zip_with(F.col(features), arrays.literal(means), lambda x, m: x - m)
    scored = df.withColumn("_z", centred)
    return scored.withColumn(
        "scores", F.array(*[arrays.dot(F.col("_z"), arrays.literal(c)) for c in components])
    ).drop("_z")


def pca_project(df: DataFrame, k: int = 2, features: str = "features") -> DataFrame:
    """Adds ``scores``: the first k principal components of the pooled rows, centred and not scaled."""
    moments = gramian(df.select(F.lit("all").alias("client_id"), features)).where(F.col("client_id") == GLOBAL).first()
    means = np.asarray(moments.means)
    _, components, _ = _principal(moments.n, means, np.asarray(moments.second), k, False)
    return _project(df, components, means, features)


def class_scatter(df: DataFrame, label: str = "label", features: str = "features") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overall mean, within-class and between-class scatter from one pass: d×d numbers per class reach the driver."""

    def statistics(_, rows: pd.DataFrame) -> np.ndarray:
        x = np.stack(rows[features].to_numpy())
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    sums = partial_sums(df.select(label, features), statistics, label)
    listed = sums.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v")
    ).orderBy(label)
    found = [np.asarray(r["v"]) for r in listed.collect()]
    d = int(round((np.sqrt(4 * len(found[0]) - 3) - 1) / 2))
    total = sum(v[0] for v in found)
    mean = sum(v[1:1 + d] for v in found) / total
    within, between = np.zeros((d, d)), np.zeros((d, d))
    for v in found:
        m = v[1:1 + d] / v[0]
        within += v[1 + d:].reshape(d, d) - v[0] * np.outer(m, m)
        between += v[0] * np.outer(m - mean, m - mean)
    return mean, within, between


def lda_directions(within: np.ndarray, between: np.ndarray, k: int) -> np.ndarray:
    """Directions of largest between-class against within-class scatter: a symmetric problem in whitened coordinates."""
    d = len(within)
    ridge = 1e-10 * max(np.trace(within) / d, 1e-300)
    values, vectors = np.linalg.eigh(within + ridge * np.eye(d))
    white = vectors / np.sqrt(values)
    gain, axes = np.linalg.eigh(white.T @ between @ white)
    found = (white @ axes[:, np.argsort(-gain)[:k]]).T
    signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
    return found * signs[:, None]


def lda_project(df: DataFrame, k: int = 2, label: str = "label", features: str = "features") -> DataFrame:
    """Adds ``scores``: the k directions that separate the classes best."""
    mean, within, between = class_scatter(df, label, features)
    return _project(df, lda_directions(within, between, k), mean, features)

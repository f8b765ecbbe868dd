"""Boosted trees of all silos and classes at once, grown level by level from gradient histograms.

Features are cut into a bounded number of bins at edges that all silos share. A level is one job: tasks add up gradients and
curvatures by silo, class, node, feature and bin while they stream over rows, only those sums are shuffled, and each silo's
best splits are chosen where its sums meet. Row scores are worked out again in each pass from the trees so far, which every
task holds; so nothing of row size is stored between levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from silovalue.functions.lineage import control_table
from silovalue.operators import metrics as M, shapley as S
from silovalue.operators.fit import partial_sums
from silovalue.operators.metrics import EPSILON

BINS = 32
MAX_NODES = 5_000_000  # nodes of all trees, which every task gets
LOSSES = ("squared", "softmax")


@dataclass
class Tree:
    """A full binary tree as arrays: node i has the children 2i + 1 (feature <= threshold) and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n), np.zeros(n))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node that each row has reached."""
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, f] > self.threshold[at]))
        return at


Forest = dict[object, list[list[Tree]]]  # silo -> class -> trees


def scores(x: np.ndarray, forest: list[list[Tree]]) -> np.ndarray:
    """rows × classes: the sum of each class's trees."""
    return np.stack([sum((t.value[t.place(x)] for t in own), np.zeros(len(x))) for own in forest], axis=1)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def clean_rows(df: DataFrame) -> DataFrame:
    """(client_id, features, target) of the rows with a silo, a full vector and a target."""
    x, y = F.col("features").cast("array<double>"), F.col("target").cast("array<double>")
    return df.select("client_id", x.alias("features"), y.alias("target")).where(
        F.col("client_id").isNotNull() & F.col("target").isNotNull() & F.col("features").isNotNull() & F.forall("features", lambda v: v.isNotNull()))


def quantile_edges(df: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """For each feature at most bins - 1 borders with about as many rows between them, from one pass over all rows."""
    wanted = [i / bins for i in range(1, bins)]
    found = df.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(
        F.percentile_approx("v", wanted, 100 * bins).alias("q"), F.max("v").alias("top")).orderBy("pos").collect()
    return [np.unique([v for v in r.q if v < r.top]) for r in found]


def fit_trees_per_client(
    train: DataFrame, classes: int, rounds: int = 3, depth: int = 3, rate: float = 0.3, l2: float = 1.0, loss: str = "squared",
    least_weight: float = 1.0, edges: list | None = None,
) -> Forest:
    """Per silo and class ``rounds`` trees that score the class: rounds × depth jobs, whatever the number of silos.

    ``train`` is (client_id, features, target); rows that lack one are left out. ``squared`` fits each column of the target
    by itself, ``softmax`` all columns as one class. Of equal gains the first feature and the lowest border wins.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss is one of {LOSSES}")
    rows = clean_rows(train)
    edges = [np.asarray(e, dtype=float) for e in (edges if edges is not None else quantile_edges(rows))]
    silos = [r[0] for r in rows.select("client_id").distinct().orderBy("client_id").collect()]
    if len(silos) * classes * rounds * 2 ** (depth + 1) > MAX_NODES:
        raise ValueError("the trees are too large to be shipped to every task")
    forest: Forest = {s: [[] for _ in range(classes)] for s in silos}
    for _ in range(rounds):
        for own in forest.values():
            for c in range(classes):
                own[c].append(Tree.blank(depth))
        for level in range(depth):
            if not _grow(rows, forest, edges, level, rate, l2, loss, least_weight):
                break
    return forest


def _grow(rows: DataFrame, forest: Forest, edges: list[np.ndarray], level: int, rate: float, l2: float, loss: str, least_weight: float) -> int:
    """Splits the nodes of one level of every silo's and class's last tree; the number of splits."""
    shipped = rows.sparkSession.sparkContext.broadcast((forest, edges))
    classes = len(next(iter(forest.values()), []))
    nodes, width = 2**level, 1 + max((len(e) for e in edges), default=0)
    shape = (classes, nodes, len(edges), width, 2)

    def statistics(silo, part: pd.DataFrame) -> np.ndarray:
        trees, cuts = shipped.value
        x, y = np.stack(part["features"].to_numpy()), np.stack(part["target"].to_numpy())
        before = scores(x, [own[:-1] for own in trees[silo]])
        if loss == "softmax":
            p = _softmax(before)
            slope, bend = p - y, p * (1 - p)
        else:
            slope, bend = before - y, np.ones_like(y)
        bins = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
        out = np.zeros(shape)
        for c, own in enumerate(trees[silo]):
            at = own[-1].place(x) - (nodes - 1)
            here = at >= 0
            for f, b in enumerate(bins):
                cell = at[here] * width + b[here]
                for k, v in enumerate((slope, bend)):
                    out[c, :, f, :, k] = np.bincount(cell, v[here, c], nodes * width).reshape(nodes, width)
        return out.ravel()

    sums = partial_sums(rows, statistics)
    listed = sums.groupBy("client_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v"))
    kind = dict(rows.dtypes)["client_id"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for silo, v in zip(batch["client_id"], batch["v"]):
                left = np.array(v).reshape(shape).cumsum(axis=3)
                for c, node in np.ndindex(classes, nodes):
                    whole = left[c, node, 0, -1]
                    best = _best_split(left[c, node], whole, edges, l2, least_weight)
                    if best is not None:
                        f, b, below = best
                        above = whole - below
                        out.append((silo, c, node, f, float(edges[f][b]), *(float(-rate * g / (h + l2)) for g, h in (below, above))))
                    elif level == 0:
                        out.append((silo, c, node, -1, 0.0, float(-rate * whole[0] / (whole[1] + l2)), 0.0))
            yield pd.DataFrame(out, columns=["client_id", "class", "node", "feature", "threshold", "low", "high"])

    found = listed.mapInPandas(choose, f"client_id {kind}, class int, node int, feature int, threshold double, low double, high double").collect()
    for r in found:
        tree, i = forest[r.client_id][r["class"]][-1], nodes - 1 + r.node
        if r.feature < 0:
            tree.value[i] = r.low
            continue
        tree.feature[i], tree.threshold[i] = r.feature, r.threshold
        tree.value[2 * i + 1], tree.value[2 * i + 2] = r.low, r.high
    return sum(r.feature >= 0 for r in found)


def _best_split(left: np.ndarray, whole: np.ndarray, edges: list[np.ndarray], l2: float, least_weight: float) -> tuple | None:
    """(feature, border, sums below it) of the largest positive gain; ``left`` is features × bins × (slope, bend), cumulated."""
    best, most = None, 1e-9
    for f, cuts in enumerate(edges):
        below = left[f, : len(cuts)]
        above = whole - below
        fine = (below[:, 1] >= least_weight) & (above[:, 1] >= least_weight)
        if not fine.any():
            continue
        gain = np.where(fine, sum(s[:, 0] ** 2 / (s[:, 1] + l2) for s in (below, above)) - whole[0] ** 2 / (whole[1] + l2), -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > most:
            best, most = (f, b, below[b]), gain[b]
    return best


def _leaves(tree: Tree, node: int = 0, conditions: tuple = ()) -> list[tuple[list, float]]:
    if tree.feature[node] < 0:
        return [(list(conditions), float(tree.value[node]))]
    split = int(tree.feature[node]), float(tree.threshold[node])
    return _leaves(tree, 2 * node + 1, (*conditions, (*split, True))) + _leaves(tree, 2 * node + 2, (*conditions, (*split, False)))


LEAF_SCHEMA = (
    "client_id string, tree_id bigint, class int, leaf int, "
    "conditions array<struct<feature:int, threshold:double, below:boolean>>, score double"
)


def tree_table(spark, models: Forest) -> DataFrame:
    """(client_id, tree_id, class, leaf, conditions, score): one row per leaf; a row is in it if it meets all conditions."""
    rows = []
    for silo, per_class in models.items():
        tree_id = 0
        for c, own in enumerate(per_class):
            for tree in own:
                rows += [(str(silo), tree_id, c, leaf, conditions, score) for leaf, (conditions, score) in enumerate(_leaves(tree))]
                tree_id += 1
    return spark.createDataFrame(rows, LEAF_SCHEMA)


def silo_scores(rows: DataFrame, models: Forest, features: str = "features") -> DataFrame:
    """(row columns, silo_scores): per silo the class scores of its trees, as a map from silo to array.

    Rows without a vector, or with a null in it, have a null map.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("map<string, array<double>>")
    def score(vectors: pd.Series) -> pd.Series:
        whole = np.array([v is not None and not np.isnan(np.asarray(v, dtype=float)).any() for v in vectors], dtype=bool)
        out = pd.Series([None] * len(vectors), dtype=object)
        if whole.any():
            x = np.stack([np.asarray(v, dtype=float) for v in vectors[whole]])
            found = {str(silo): scores(x, forest) for silo, forest in shipped.value.items()}
            for i, at in enumerate(np.flatnonzero(whole)):
                out.iloc[at] = {silo: s[i].tolist() for silo, s in found.items()}
        return out

    return rows.withColumn("silo_scores", score(F.col(features).cast("array<double>")))


# ---------------------------------------------------------------- coalitions of silos' trees


def gray_code(n: int) -> Iterator[tuple[int, int]]:
    """(silo toggled, mask after it) through all masks but the empty one."""
    mask = 0
    for step in range(1, 1 << n):
        bit = (step & -step).bit_length() - 1
        mask ^= 1 << bit
        yield bit, mask


def tree_coalition_utility(rows: DataFrame, models: Forest, base: Forest | None = None) -> DataFrame:
    """(evaluator, mask, metric, value): cross entropy and accuracy of the base trees plus each coalition's trees.

    ``rows`` is (client_id, features, target). A task scores its rows once per silo; scores add up, so the subsets are
    walked in Gray code, adding or taking away one silo's scores each time, and only sums by mask leave the task. Mask 0 is
    the base alone (no scores without one); bit p is the p-th silo in sorted order. At most 12 silos.
    """
    silos = sorted(models)
    if len(silos) > S.MAX_PLAYERS:
        raise ValueError(f"more than {S.MAX_PLAYERS} silos")
    shipped = rows.sparkSession.sparkContext.broadcast(([models[s] for s in silos], list((base or {}).values())))
    masks = 1 << len(silos)

    def statistics(_, part: pd.DataFrame) -> np.ndarray:
        members, first = shipped.value
        x, y = np.stack(part["features"].to_numpy()), np.stack(part["target"].to_numpy())
        own = [scores(x, m) for m in members]
        running = sum((scores(x, b) for b in first), np.zeros(y.shape))
        true, out = y.argmax(axis=1), np.zeros((masks, 2))
        lines = np.arange(len(x))

        def measured() -> tuple[float, int]:
            p = np.clip(_softmax(running)[lines, true], EPSILON, 1 - EPSILON)
            return -np.log(p).sum(), int((running.argmax(axis=1) == true).sum())

        out[0] = measured()
        for bit, mask in gray_code(len(silos)):
            running = running + own[bit] if mask >> bit & 1 else running - own[bit]
            out[mask] = measured()
        return np.concatenate([[len(x)], out.ravel()])

    sums = M.with_global(partial_sums(clean_rows(rows), statistics)).groupBy("evaluator", "pos").agg(F.sum("value").alias("value"))
    sums = control_table(sums)
    n = sums.where("pos = 0").select("evaluator", F.col("value").alias("n"))
    metric = F.when(F.col("pos") % 2 == 1, "CrossEntropyLoss").otherwise("Accuracy")
    return sums.where("pos > 0").join(n, "evaluator").select(
        "evaluator", F.floor((F.col("pos") - 1) / 2).cast("bigint").alias("mask"), metric.alias("metric"), (F.col("value") / F.col("n")).alias("value"))


def shapley_values_fitted_trees(utility: DataFrame, clients: DataFrame) -> DataFrame:
    """(evaluator, metric, client_id, value): what each silo's trees add to the base; ``clients`` has the silos of the trees."""
    start = utility.where("mask = 0").select("evaluator", "metric", "value")
    return S.shapley_values(utility.where("mask > 0"), clients, start, ["evaluator", "metric"])

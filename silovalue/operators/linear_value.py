"""Regression value of silos: linear models per silo, coalitions by averaging, utilities as quadratic forms.

Rows are read once for sums of products per silo. From them come the silos' least-squares models and, for the test rows,
the squared error of any model w as wᵀGw − 2wᵀc + s, without touching a row again. Only the absolute error needs rows: one
scoring pass adds it up for all models at once. Sums are taken around a common centre, so large offsets don't cancel digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from silovalue.functions.lineage import control_table
from silovalue.operators import metrics as M, shapley as S
from silovalue.operators.fit import partial_sums, with_bias

METRICS = ("RMSE", "MSE", "MAE", "R2")
SCORED_AT_ONCE = 4_000_000  # numbers of one block of rows × models
MAX_NUMBERS = 20_000_000  # of models or sums that every task gets


def clean_rows(df: DataFrame, features: str = "features", target: str = "y") -> DataFrame:
    """(client_id, features, y) of the rows that count: with a silo, a target and a vector without nulls."""
    x = F.col(features).cast("array<double>")
    return df.select("client_id", x.alias("features"), F.col(target).cast("double").alias("y")).where(
        F.col("client_id").isNotNull() & F.col("y").isNotNull() & F.col("features").isNotNull() & F.forall("features", lambda v: v.isNotNull()))


def centre(df: DataFrame) -> np.ndarray:
    """Mean of each feature and of the target over all rows; the vectors must have one length."""
    found = df.select(F.posexplode(F.concat("features", F.array("y"))).alias("pos", "v")).groupBy("pos").agg(
        F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()
    if len({r.n for r in found}) > 1:
        raise ValueError("feature vectors have different lengths")
    return np.array([r.m for r in found])


def product_sums(df: DataFrame, around: np.ndarray) -> DataFrame:
    """(client_id, v): per silo Σzzᵀ with z = (features − centre, 1, y − centre), a flat (d+2)² vector."""

    def statistics(_, rows: pd.DataFrame) -> np.ndarray:
        x = with_bias(np.stack(rows["features"].to_numpy()) - around[:-1])
        z = np.hstack([x, rows["y"].to_numpy()[:, None] - around[-1]])
        return (z.T @ z).ravel()

    sums = partial_sums(df.select("client_id", "features", "y"), statistics)
    return control_table(sums.groupBy("client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v")))


def fit_linear_per_client(sums: DataFrame, around: np.ndarray, ridge: float = 0.0) -> DataFrame:
    """(client_id, pos, value, n_examples): least-squares weights of each silo in the original units, the bias last.

    Where a silo's rows do not settle all weights, the smallest ones are taken.
    """
    kind = dict(sums.dtypes)["client_id"]
    mean, offset = around[:-1], around[-1]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for silo, v in zip(batch["client_id"], batch["v"]):
                m = np.array(v).reshape(len(mean) + 2, -1)
                g, c = m[:-1, :-1].copy(), m[:-1, -1]
                g[np.arange(len(mean)), np.arange(len(mean))] += ridge
                w = np.linalg.lstsq(g, c, rcond=None)[0]
                w[-1] += offset - w[:-1] @ mean
                out += [(silo, i, float(x), int(round(m[-2, -2]))) for i, x in enumerate(w)]
            yield pd.DataFrame(out, columns=["client_id", "pos", "value", "n_examples"])

    return sums.mapInPandas(solve, f"client_id {kind}, pos int, value double, n_examples bigint")


def model_vectors(weights: DataFrame, keys: list[str], positions: int) -> DataFrame:
    """(keys, w): the weights of each model as one array, and nothing (zeros) for the empty coalition if it is a key."""
    listed = weights.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("w"))
    if keys != ["mask"]:
        return listed
    none = weights.sparkSession.createDataFrame([(0, [0.0] * positions)], "mask bigint, w array<double>")
    return listed.unionByName(none)


def _evaluators(sums: DataFrame) -> dict[str, np.ndarray]:
    """Product sums of each silo's test rows and of all of them, as the driver's control data."""
    rows = sums.collect()
    if sum(len(r.v) for r in rows) > MAX_NUMBERS:
        raise ValueError("product sums are too large to be shipped to every task")
    out = {str(r.client_id): np.array(r.v).reshape(int(round(len(r.v) ** 0.5)), -1) for r in rows}
    if out:
        out["Global"] = np.sum(list(out.values()), axis=0)
    return out


def squared_errors(models: DataFrame, keys: list[str], sums: DataFrame, around: np.ndarray) -> DataFrame:
    """(keys, evaluator, n, sse, sst) of each model on each silo's test rows and on all, from the sums alone."""
    shipped = models.sparkSession.sparkContext.broadcast(_evaluators(sums))
    types = dict(models.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", evaluator string, n bigint, sse double, sst double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            w = np.stack(batch["w"].to_numpy())
            w = np.hstack([w[:, :-1], w[:, -1:] + w[:, :-1] @ around[:-1, None] - around[-1], -np.ones((len(w), 1))])  # error = w·z
            for evaluator, m in shipped.value.items():
                out = batch[keys].copy()
                out["evaluator"], out["n"] = evaluator, int(round(m[-2, -2]))
                out["sse"] = np.maximum(np.einsum("ij,jk,ik->i", w, m, w), 0.0)
                out["sst"] = m[-1, -1] - m[-1, -2] ** 2 / m[-2, -2]
                yield out

    return models.select(*keys, "w").mapInPandas(score, schema)


def absolute_errors(rows: DataFrame, models: DataFrame, key: str = "mask") -> DataFrame:
    """(key, evaluator, sae) of all models on each silo's rows and on all, in one pass over the rows."""
    found = models.select(key, "w").orderBy(key).collect()
    if sum(len(r.w) for r in found) > MAX_NUMBERS:
        raise ValueError("models are too large to be shipped to every task")
    shipped = rows.sparkSession.sparkContext.broadcast(np.array([r.w for r in found], dtype=np.float64))
    names = F.array(*[F.lit(r[key]).cast(dict(models.dtypes)[key]) for r in found])

    def statistics(_, part: pd.DataFrame) -> np.ndarray:
        w = shipped.value
        x, y = with_bias(np.stack(part["features"].to_numpy())), part["y"].to_numpy()
        step = max(1, SCORED_AT_ONCE // len(w))
        return sum(np.abs(x[a : a + step] @ w.T - y[a : a + step, None]).sum(axis=0) for a in range(0, len(x), step))

    sums = partial_sums(rows.select("client_id", "features", "y"), statistics)
    own = sums.select(F.element_at(names, F.col("pos") + 1).alias(key), F.col("client_id").cast("string").alias("evaluator"), "value")
    both = own.unionByName(own.withColumn("evaluator", F.lit("Global")))
    return both.groupBy(key, "evaluator").agg(F.sum("value").alias("sae"))


def coalition_utility_regression(
    train: DataFrame, test: DataFrame, metrics: tuple[str, ...] = METRICS, ridge: float = 0.0
) -> DataFrame:
    """(evaluator, mask, metric, value) of every coalition, the empty one (mask 0: the zero model) included.

    ``train`` and ``test`` are ``clean_rows``. Silos without training rows are no players; those without test rows no
    evaluators.
    """
    around = centre(train)
    fitted = control_table(fit_linear_per_client(product_sums(train, around), around, ridge))
    models = model_vectors(S.coalition_models(fitted, ["pos"], fitted), ["mask"], len(around))
    models = control_table(models)
    counts = squared_errors(models, ["mask"], product_sums(test, around), around)
    if "MAE" in metrics:
        counts = counts.join(absolute_errors(test, models), ["mask", "evaluator"])
    else:
        counts = counts.withColumn("sae", F.lit(None).cast("double"))
    return M.regression_metrics(counts, ["evaluator", "mask"]).where(F.col("metric").isin(*metrics))


def shapley_values_regression(utility: DataFrame, clients: DataFrame) -> DataFrame:
    """(evaluator, metric, client_id, value) from ``coalition_utility_regression``'s rows; the zero model is the start."""
    start = utility.where("mask = 0").select("evaluator", "metric", "value")
    return S.shapley_values(utility.where("mask > 0"), clients, start, ["evaluator", "metric"])


def cross_losses_regression(train: DataFrame, test: DataFrame, ridge: float = 0.0) -> DataFrame:
    """(model, client_id, value): mean absolute error of every silo's model, and of the one of all rows, on every test set."""
    around = centre(train)
    own = product_sums(train.withColumn("client_id", F.col("client_id").cast("string")), around)
    everything = own.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    sums = own.unionByName(everything.select(F.lit(M.GLOBAL).alias("client_id"), "v"))
    models = control_table(model_vectors(fit_linear_per_client(sums, around, ridge), ["client_id"], len(around)))
    sizes = test.groupBy(F.col("client_id").cast("string").alias("evaluator")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.unionByName(sizes.agg(F.lit(M.GLOBAL).alias("evaluator"), F.sum("n").alias("n")))
    found = absolute_errors(test, models, "client_id").withColumnRenamed("client_id", "model")
    return found.join(sizes, "evaluator").select("model", F.col("evaluator").alias("client_id"), (F.col("sae") / F.col("n")).alias("value"))


# ---------------------------------------------------------------- more silos than a lattice can hold


def sampled_orders(clients: DataFrame, pairs: int, seed: int = 1, client: str = "client_id") -> DataFrame:
    """(pair, turned, place, client_id): ``pairs`` orders of the silos by a hash, each followed by its reverse."""
    silos = clients.select(client).where(F.col(client).isNotNull()).distinct()
    drawn = silos.withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1)))).withColumn(
        "_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pair").cast("string"), F.col(client).cast("string"))))
    own = Window.partitionBy("pair")
    placed = drawn.withColumn("place", F.row_number().over(own.orderBy("_h", client))).withColumn("n", F.count(F.lit(1)).over(own))
    both = placed.withColumn("turned", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.select("pair", "turned", F.when(F.col("turned"), F.col("n") + 1 - F.col("place")).otherwise(F.col("place")).alias("place"), client)


def prefix_models(orders: DataFrame, params: DataFrame, positions: list[str], client: str = "client_id") -> DataFrame:
    """(pair, turned, place, positions, value): the weighted average of each order's first silos, built up by running sums."""
    so_far = Window.partitionBy("pair", "turned", *positions).orderBy("place")
    joined = orders.join(params, client)
    weighted = F.sum(F.col("n_examples") * F.col("value")).over(so_far) / F.sum("n_examples").over(so_far)
    return joined.select("pair", "turned", "place", client, *positions, weighted.alias("value"))


def order_values(scored: DataFrame, keys: list[str], client: str = "client_id") -> DataFrame:
    """(keys, client_id, value, standard_error, orders) from the utilities of all prefixes, place 0 (no silo) included.

    ``scored`` is (keys, pair, turned, place, client_id, value), gains positive. The two orders of a pair count as one
    draw, whose mean varies less; the standard error is that of the pairs' means (null for a single pair).
    """
    walk = Window.partitionBy(*keys, "pair", "turned").orderBy("place")
    steps = scored.withColumn("gain", F.col("value") - F.lag("value").over(walk)).where("place > 0")
    drawn = steps.groupBy(*keys, client, "pair").agg(F.avg("gain").alias("gain"), F.count(F.lit(1)).alias("orders"))
    return drawn.groupBy(*keys, client).agg(
        F.avg("gain").alias("value"), (F.stddev_samp("gain") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"), F.sum("orders").alias("orders"))


def shapley_sampled_regression(
    train: DataFrame, test: DataFrame, pairs: int = 32, seed: int = 1, metrics: tuple[str, ...] = ("RMSE", "R2"),
    ridge: float = 0.0, orders: DataFrame | None = None,
) -> DataFrame:
    """(evaluator, metric, client_id, value, standard_error, orders): values of any number of silos over sampled orders.

    The caller chooses it over the exact lattice and how many pairs of orders are drawn, or gives the orders. Metrics of
    squared errors only, so that no prefix model touches a row.
    """
    if "MAE" in metrics:
        raise ValueError("absolute errors need a pass over the rows for every prefix model")
    around = centre(train)
    fitted = control_table(fit_linear_per_client(product_sums(train, around), around, ridge))
    orders = control_table(orders if orders is not None else sampled_orders(fitted, pairs, seed))
    keys = ["pair", "turned", "place", "client_id"]
    vectors = model_vectors(prefix_models(orders, fitted, ["pos"]), keys, len(around))
    start = orders.select("pair", "turned").distinct().select(
        "pair", "turned", F.lit(0).cast(dict(vectors.dtypes)["place"]).alias("place"), F.lit(None).cast(dict(vectors.dtypes)["client_id"]).alias("client_id"),
        F.array_repeat(F.lit(0.0), len(around)).alias("w"))
    counts = squared_errors(vectors.unionByName(start), keys, product_sums(test, around), around).withColumn("sae", F.lit(None).cast("double"))
    scored = M.regression_metrics(counts, [*keys, "evaluator"]).where(F.col("metric").isin(*metrics))
    return order_values(scored.withColumn("value", M.direction() * F.col("value")), ["evaluator", "metric"])

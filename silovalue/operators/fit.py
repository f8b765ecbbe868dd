"""Fitting linear class and regression models of all silos at once.

One Spark job per step: tasks turn their rows into partial sums with NumPy, and only sums of model size are shuffled.
Model parameters (silos × classes × features) are the control data that the driver holds between steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, functions as F

from silovalue.functions import arrays
from silovalue.functions.hashing import hash_below
from silovalue.functions.lineage import cut_lineage
from silovalue.operators.metrics import EPSILON, cross_entropy

MAX_PARAMETERS = 20_000_000
FLUSH_NUMBERS = 4_000_000

Models = dict[object, np.ndarray]


def _check_size(models: Models) -> None:
    if sum(w.size for w in models.values()) > MAX_PARAMETERS:
        raise ValueError("models are too large to be shipped to every task")


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def class_targets(df: DataFrame, labels: Column, label: str = "label") -> DataFrame:
    """Adds ``target``: the one-hot row of the class in the sorted class list."""
    return df.withColumn("_labels", labels).withColumn(
        "target", F.transform("_labels", lambda c: F.when(c == F.col(label), F.lit(1.0)).otherwise(F.lit(0.0)))
    ).drop("_labels")


def partial_sums(
    df: DataFrame, statistics: Callable[[object, pd.DataFrame], np.ndarray], group: str = "client_id"
) -> DataFrame:
    """(group, pos, value): element-wise sum over all rows of ``statistics(group, rows)``, a flat vector.

    Every task adds up per group while it streams over its batches; the vectors are summed by position afterwards, so a
    group that holds a third of the rows is spread over all tasks. Rows of a null group are a group of their own. A task
    hands its sums on when they hold ``FLUSH_NUMBERS`` numbers, so its memory does not grow with the number of groups.
    """
    kind = dict(df.dtypes)[group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(group, sort=False, dropna=False):
                key = None if pd.isna(key) else key
                found = statistics(key, rows)
                sums[key] = sums[key] + found if key in sums else found
            if sum(v.size for v in sums.values()) >= FLUSH_NUMBERS:
                yield pd.DataFrame({group: list(sums), "sums": [v.tolist() for v in sums.values()]})
                sums = {}
        if sums:
            yield pd.DataFrame({group: list(sums), "sums": [v.tolist() for v in sums.values()]})

    partial = df.mapInPandas(run, f"{group} {kind}, sums array<double>")
    return partial.select(group, F.posexplode("sums").alias("pos", "value")).groupBy(group, "pos").agg(
        F.sum("value").alias("value")
    )


def _collect_vectors(sums: DataFrame, group: str = "client_id") -> dict[object, np.ndarray]:
    vectors = sums.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v")
    )
    return {r[group]: np.array(r["v"]) for r in vectors.collect()}


def gradient_sums(df: DataFrame, models: Models, loss: str = "CE") -> DataFrame:
    """(client_id, pos, value): position 0 rows, 1 loss sum, then the gradient sum of the silo's model, row by row.

    ``df`` is (client_id, features, target); rows that lack one of them have no model or no slope and are left out. Losses:
    CE (softmax), MAE and MSE (linear).
    """
    _check_size(models)
    shipped = df.sparkSession.sparkContext.broadcast(models)

    def statistics(key, rows: pd.DataFrame) -> np.ndarray:
        w = shipped.value[key]
        x = with_bias(np.stack(rows["features"].to_numpy()))
        y = np.stack(rows["target"].to_numpy())
        scores = x @ w.T
        if loss == "CE":
            p = _softmax(scores)
            cost = -(y * np.log(np.clip(p, EPSILON, 1 - EPSILON))).sum()
            slope = p - y
        elif loss == "MAE":
            cost, slope = np.abs(scores - y).sum(), np.sign(scores - y)
        else:
            cost, slope = ((scores - y) ** 2).sum(), 2 * (scores - y)
        return np.concatenate([[len(x), cost], (slope.T @ x).ravel()])

    usable = F.col("client_id").isNotNull() & F.col("features").isNotNull() & F.col("target").isNotNull()
    return partial_sums(df.select("client_id", "features", "target").where(usable), statistics)


def loss_gradient(df: DataFrame, models: Models, loss: str = "CE") -> DataFrame:
    """(client_id, pos, value): mean gradient per silo over its rows, one row per model parameter."""
    sums = gradient_sums(df, models, loss)
    rows = sums.where(F.col("pos") == 0).select("client_id", F.col("value").alias("n"))
    return sums.where(F.col("pos") >= 2).join(rows, "client_id").select(
        "client_id", (F.col("pos") - 2).cast("bigint").alias("pos"), (F.col("value") / F.col("n")).alias("value")
    )


@dataclass
class Step:
    """Rows, mean loss and mean gradient per silo."""

    rows: dict[object, float] = field(default_factory=dict)
    loss: dict[object, float] = field(default_factory=dict)
    gradient: Models = field(default_factory=dict)


def gradient_step(df: DataFrame, models: Models, loss: str = "CE") -> Step:
    step = Step()
    for key, v in _collect_vectors(gradient_sums(df, models, loss)).items():
        step.rows[key] = float(v[0])
        step.loss[key] = float(v[1] / v[0])
        step.gradient[key] = (v[2:] / v[0]).reshape(models[key].shape)
    return step


def decayed(rate: float, decay: float, step: int, decay_steps: int) -> float:
    """rate · decay^(step / decay_steps)."""
    return rate * decay ** (step / decay_steps)


def model_average(models: Models, weights: dict[object, float]) -> np.ndarray:
    total = sum(weights[k] for k in models)
    return sum(weights[k] / total * models[k] for k in models)


def zero_models(silos: list, classes: int, features: int) -> Models:
    return {s: np.zeros((classes, features + 1)) for s in silos}


def shape_of(df: DataFrame) -> tuple[list, int, int]:
    """Silo list, classes and features of a (client_id, features, target) table."""
    row = df.agg(
        F.max(F.size("target")).alias("k"), F.max(F.size("features")).alias("d"), F.min(F.size("features")).alias("m")
    ).first()
    if row.d != row.m:
        raise ValueError("feature vectors differ in length")
    silos = [r[0] for r in df.select("client_id").distinct().orderBy("client_id").limit(100_001).collect()]
    if len(silos) > 100_000:
        raise ValueError("too many silos")
    return silos, row.k, row.d


def class_outcomes(df: DataFrame, models: Models) -> DataFrame:
    """(model, client_id, true, predicted, n, ce): every model scored on every row in one pass, as counts.

    ``true`` and ``predicted`` are class positions. Rows never leave their task; what is shuffled has the size
    models × silos × classes².
    """
    _check_size(models)
    keys = list(models)
    stacked = df.sparkSession.sparkContext.broadcast(np.stack([models[k] for k in keys]))
    kind = dict(df.dtypes)["client_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = stacked.value
        n_models, k, _ = w.shape
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby("client_id", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                x = with_bias(np.stack(rows["features"].to_numpy()))
                true = np.stack(rows["target"].to_numpy()).argmax(axis=1)
                cell = sums.setdefault(key, np.zeros((2, n_models, k, k)))
                for m in range(n_models):
                    p = _softmax(x @ w[m].T)
                    predicted = p.argmax(axis=1)
                    ce = -np.log(np.clip(p[np.arange(len(x)), true], EPSILON, 1 - EPSILON))
                    np.add.at(cell[0, m], (true, predicted), 1)
                    np.add.at(cell[1, m], (true, predicted), ce)
            if sum(c.size for c in sums.values()) >= FLUSH_NUMBERS:
                yield _table(sums)
                sums = {}
        if sums:
            yield _table(sums)

    def _table(sums: dict[object, np.ndarray]) -> pd.DataFrame:
        parts = []
        for key, cell in sums.items():
            m, t, p = np.nonzero(cell[0])
            parts.append(pd.DataFrame({
                "model": [str(keys[i]) for i in m], "client_id": key, "true": t, "predicted": p,
                "n": cell[0, m, t, p].astype(np.int64), "ce": cell[1, m, t, p],
            }))
        return pd.concat(parts)

    schema = f"model string, client_id {kind}, true int, predicted int, n bigint, ce double"
    usable = F.col("features").isNotNull() & F.col("target").isNotNull()
    partial = df.select("client_id", "features", "target").where(usable).mapInPandas(run, schema)
    return partial.groupBy("model", "client_id", "true", "predicted").agg(F.sum("n").alias("n"), F.sum("ce").alias("ce"))


@dataclass
class Federation:
    """What a federated run leaves: models per round and long tables of its history."""

    models: list[np.ndarray]
    silo_models: list[Models]
    rows: dict[object, float]
    losses: list[dict[object, float]]
    gradients: list[Models]


def federated_rounds(
    train: DataFrame, rounds: int, rate: float = 0.5, local_steps: int = 1, decay: float = 1.0, decay_steps: int = 100,
    scale_by_share: bool = False, start: np.ndarray | None = None, loss: str = "CE",
) -> Federation:
    """Local steps of every silo from the shared model, then the average weighted by rows; repeated.

    All silos move in the same job. ``scale_by_share`` multiplies a silo's rate by its share of the rows.
    """
    silos, k, d = shape_of(train)
    shared = np.zeros((k, d + 1)) if start is None else start
    run = Federation([shared], [], {}, [], [])
    clock = 0
    for _ in range(rounds):
        models = {s: shared.copy() for s in silos}
        for local in range(local_steps):
            step = gradient_step(train, models, loss)
            run.rows = step.rows
            total = sum(step.rows.values())
            speed = decayed(rate, decay, clock, decay_steps)
            for s in models:
                own = speed * (step.rows[s] / total if scale_by_share else 1.0)
                models[s] = models[s] - own * step.gradient[s]
            if local == 0:
                run.losses.append(step.loss)
                run.gradients.append(step.gradient)
            clock += 1
        shared = model_average(models, run.rows)
        run.models.append(shared)
        run.silo_models.append(models)
    return run


def gradient_table(run: Federation, df: DataFrame) -> DataFrame:
    """(round, client_id, pos, value) of the first gradient of each round."""
    kind = dict(df.dtypes)["client_id"]
    rows = [
        (r + 1, s, [float(v) for v in g.ravel()]) for r, step in enumerate(run.gradients) for s, g in step.items()
    ]
    table = df.sparkSession.createDataFrame(rows, f"round int, client_id {kind}, g array<double>")
    return table.select("round", "client_id", F.posexplode("g").alias("pos", "value"))


def early_stop(
    rows: DataFrame, id_col: str = "row_id", seed: int = 11, share: float = 0.2, patience: int = 2, rate: float = 0.5,
    max_steps: int = 50, loss: str = "CE",
) -> tuple[Models, list[tuple[int, object, float, float]]]:
    """Trains every silo until its validation loss has not improved for ``patience`` steps; keeps the best model.

    Training and validation sums come from the same job. Returns the models and (step, silo, train, validation loss).
    """
    flagged = rows.withColumn("_valid", hash_below(seed, share, id_col))
    silos, k, d = shape_of(rows)
    models = zero_models(silos, k, d)
    best: dict[object, tuple[float, np.ndarray]] = {}
    waiting, history = {s: 0 for s in silos}, []
    side = F.when(F.col("_valid"), F.lit("v")).otherwise(F.lit("t"))
    by_part = flagged.select(F.concat_ws("|", F.col("client_id").cast("string"), side).alias("client_id"), "features", "target")
    for number in range(max_steps):
        active = [s for s in silos if waiting[s] < patience]
        if not active:
            break
        shipped = {f"{s}|{side}": models[s] for s in silos for side in ("t", "v")}
        step = gradient_step(by_part, shipped, loss)
        for s in active:
            valid = step.loss.get(f"{s}|v", step.loss.get(f"{s}|t", 0.0))
            history.append((number, s, step.loss.get(f"{s}|t", 0.0), valid))
            if s not in best or valid < best[s][0]:
                best[s], waiting[s] = (valid, models[s].copy()), 0
            else:
                waiting[s] += 1
            if f"{s}|t" in step.gradient:
                models[s] = models[s] - rate * step.gradient[f"{s}|t"]
    return {s: best[s][1] for s in silos}, history


def soft_targets(df: DataFrame, models: list[np.ndarray]) -> DataFrame:
    """Replaces ``target`` by the mean class probabilities of several models: labels to distil from."""
    shipped = df.sparkSession.sparkContext.broadcast(models)
    others = [c for c in df.columns if c != "target"]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*others).dtypes) + ", target array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = with_bias(np.stack(batch["features"].to_numpy()))
            mean = np.mean([_softmax(x @ w.T) for w in shipped.value], axis=0)
            yield batch[others].assign(target=list(mean))

    return df.mapInPandas(run, schema)


def distill_soft_labels(
    df: DataFrame, teachers: list[np.ndarray], start: np.ndarray, rate: float = 0.5, steps: int = 5
) -> tuple[np.ndarray, list[float]]:
    """Trains one model to match the mean output of the teachers by cross entropy; returns it and its losses."""
    pooled = soft_targets(df.withColumn("client_id", F.lit("all")), teachers)
    model, losses = start.copy(), []
    for _ in range(steps):
        step = gradient_step(pooled, {"all": model})
        losses.append(step.loss["all"])
        model = model - rate * step.gradient["all"]
    return model, losses


# ---------------------------------------------------------------- pooled models on Spark ML


def fit_central(df: DataFrame, kind: str = "logistic", seed: int = 1, **params):
    """A Spark ML model on pooled rows (features, label as number): the quality ceiling of a federation."""
    rows = df.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    if kind == "logistic":
        return LogisticRegression(**params).fit(rows), rows
    if kind == "linear":
        return LinearRegression(**params).fit(rows), rows
    if kind == "mlp":
        return MultilayerPerceptronClassifier(seed=seed, **params).fit(rows), rows
    raise ValueError(f"unknown kind of model: {kind}")


def hyperparameter_search(df: DataFrame, trials: int, seed: int = 1, parallelism: int = 4):
    """Seeded random draws from the search space, each fitted on 80% and judged by log loss on 20%.

    Returns the best model and (trial, regParam, elasticNetParam, maxIter, loss) of every trial.
    """
    rows = df.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    random = np.random.RandomState(seed)
    estimator = LogisticRegression()
    grid = []
    for _ in range(trials):
        grid += ParamGridBuilder().baseOn(
            (estimator.regParam, float(10 ** random.uniform(-4, -1))),
            (estimator.elasticNetParam, float(random.uniform(0, 1))),
            (estimator.maxIter, int(random.randint(5, 25))),
        ).build()
    judge = MulticlassClassificationEvaluator(metricName="logLoss")
    search = TrainValidationSplit(
        estimator=estimator, estimatorParamMaps=grid, evaluator=judge, trainRatio=0.8, seed=seed, parallelism=parallelism
    ).fit(rows)
    found = [
        (i, g[estimator.regParam], g[estimator.elasticNetParam], g[estimator.maxIter], float(m))
        for i, (g, m) in enumerate(zip(grid, search.validationMetrics))
    ]
    schema = "trial int, reg double, elastic double, iterations int, loss double"
    return search.bestModel, df.sparkSession.createDataFrame(found, schema)


# ---------------------------------------------------------------- distillation losses


def kullback_leibler(p: Column, q: Column) -> Column:
    """Σ p ln(p / q) with both sides kept off zero."""
    safe = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(1e-7))
    return arrays.total(F.zip_with(p, q, lambda a, b: safe(a) * F.ln(safe(a) / safe(b))))


def kd_loss(rows: DataFrame, keys: list[str], coefficient: float = 0.2) -> DataFrame:
    """Mean cross entropy plus coefficient / (2n) · mean KL(teacher, student) over (true, student, teacher) rows.

    ``true`` is the 1-based class position; the two others are probability vectors.
    """
    return rows.groupBy(*keys).agg(
        (F.avg(cross_entropy(F.element_at("student", F.col("true"))))
         + F.lit(coefficient / 2) / F.count(F.lit(1)) * F.avg(kullback_leibler(F.col("teacher"), F.col("student")))).alias("value")
    )


def decoupled_kd_loss(
    rows: DataFrame, keys: list[str], alpha: float = 1.0, beta: float = 8.0, temperature: float = 4.0
) -> DataFrame:
    """(α · target part + β · non-target part) · T² of two score vectors per row, averaged.

    The target part compares (p_true, 1 - p_true); the non-target part compares the other classes among themselves.
    """
    safe = lambda v: F.greatest(v, F.lit(1e-12))
    ps = rows.withColumn("_s", arrays.softmax(F.col("student"), temperature)).withColumn(
        "_t", arrays.softmax(F.col("teacher"), temperature)
    ).withColumn("_st", F.element_at("_s", F.col("true"))).withColumn("_tt", F.element_at("_t", F.col("true")))
    binary = F.col("_tt") * F.ln(safe(F.col("_tt")) / safe(F.col("_st"))) + (1 - F.col("_tt")) * F.ln(
        safe(1 - F.col("_tt")) / safe(1 - F.col("_st"))
    )
    others = lambda v: F.filter(v, lambda x, i: i + 1 != F.col("true"))
    rest = arrays.total(F.zip_with(
        others(F.col("_t")), others(F.col("_s")),
        lambda t, s: t / safe(1 - F.col("_tt")) * F.ln(
            safe(t / safe(1 - F.col("_tt"))) / safe(s / safe(1 - F.col("_st"))))
    ))
    return ps.groupBy(*keys).agg(
        (F.avg(alpha * binary + beta * rest) * F.lit(temperature**2)).alias("value")
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Training rows read many times: prepared once, stored in the shared checkpoint folder."""
    return cut_lineage(df)

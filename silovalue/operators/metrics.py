"""Evaluation metrics. One pass over predictions gives a small table of sufficient statistics; metrics project from it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from silovalue.functions import arrays
from silovalue.functions.lineage import control_table

GLOBAL = "Global"
EPSILON = 2.220446049250313e-16

# Metrics where smaller is better.
LOSSES = ("CrossEntropyLoss", "RMSE", "MSE", "RSE", "MAE")


def cross_entropy(p: Column) -> Column:
    return -F.ln(F.greatest(F.least(p, F.lit(1 - EPSILON)), F.lit(EPSILON)))


def with_global(df: DataFrame, client: str = "client_id", name: str = "evaluator") -> DataFrame:
    """Every row once for its own silo and once for the union of all silos."""
    return df.withColumn(name, F.explode(F.array(F.col(client).cast("string"), F.lit(GLOBAL))))


def class_counts(
    predictions: DataFrame, labels: Column, keys: list[str], label: str = "label", probs: str = "probs"
) -> DataFrame:
    """(keys, label, predicted, n, ce): confusion counts and summed cross entropy, combined on the map side."""
    scored = predictions.select(
        *keys, F.col(label).alias("label"),
        F.element_at(labels, arrays.argmax(F.col(probs)) + 1).alias("predicted"),
        cross_entropy(F.element_at(probs, F.array_position(labels, F.col(label)).cast("int"))).alias("_ce"),
    )
    return scored.groupBy(*keys, "label", "predicted").agg(F.count(F.lit(1)).alias("n"), F.sum("_ce").alias("ce"))


def add_global(counts: DataFrame, client: str = "client_id") -> DataFrame:
    """Adds the Global evaluator on the counted table, not on the rows."""
    others = [c for c in counts.columns if c not in (client, "n", "ce")]
    return with_global(counts, client).groupBy("evaluator", *others).agg(F.sum("n").alias("n"), F.sum("ce").alias("ce"))


def confusion_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.select(*keys, "label", "predicted", "n")


def cross_entropy_loss(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg((F.sum("ce") / F.sum("n")).alias("value"))


def _hits() -> Column:
    return F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))


def accuracy(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg((_hits() / F.sum("n")).alias("value"))


def class_marginals(counts: DataFrame, keys: list[str], labels: Column | None = None) -> DataFrame:
    """(keys, class, support, predicted, hits, ce) per class; with a class list also for classes that do not occur."""
    zero = F.lit(0).cast("bigint")
    same = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), same.alias("hits"), "ce"),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits"),
                 F.lit(0.0).alias("ce")),
    )
    seen = counts.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    if labels is not None:
        seen = seen.unionByName(counts.select(*keys).distinct().select(
            *keys, F.explode(labels).alias("class"), zero.alias("support"), zero.alias("predicted"), zero.alias("hits"),
            F.lit(0.0).alias("ce"),
        ))
    return seen.groupBy(*keys, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"),
        F.sum("ce").alias("ce"),
    )


def _f1() -> Column:
    return F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))


def f1_per_class(counts: DataFrame, keys: list[str], labels: Column) -> DataFrame:
    """2TP / (2TP + FP + FN) per class; 0 when undefined."""
    return class_marginals(counts, keys, labels).select(*keys, "class", _f1().alias("value"))


def f1_micro(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled counts: with one label per row every miss is one FP and one FN."""
    wrong = F.sum("n") - _hits()
    return counts.groupBy(*keys).agg((2.0 * _hits() / (2.0 * _hits() + wrong + wrong)).alias("value"))


def f1_macro(counts: DataFrame, keys: list[str], labels: Column) -> DataFrame:
    """Unweighted mean over the class list; a class that does not occur counts as 0."""
    return class_marginals(counts, keys).groupBy(*keys).agg((F.sum(_f1()) / F.size(labels)).alias("value"))


def f1_weighted(counts: DataFrame, keys: list[str]) -> DataFrame:
    return class_marginals(counts, keys).groupBy(*keys).agg(
        (F.sum(F.col("support") * _f1()) / F.sum("support")).alias("value")
    )


def _mcc_from_marginals() -> Column:
    s, c = F.sum("support").cast("double"), F.sum("hits").cast("double")
    p, t = F.col("predicted").cast("double"), F.col("support").cast("double")
    return F.coalesce(
        F.try_divide(c * s - F.sum(p * t), F.sqrt((s * s - F.sum(p * p)) * (s * s - F.sum(t * t)))), F.lit(0.0)
    )


def mcc(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Multiclass Matthews correlation from the marginals; 0 when the denominator is 0."""
    return class_marginals(counts, keys).groupBy(*keys).agg(_mcc_from_marginals().alias("value"))


def classification_metrics(counts: DataFrame, keys: list[str], labels: Column) -> DataFrame:
    """(keys, metric, value): all scalar class metrics from one grouping; a class that does not occur adds nothing."""
    wide = class_marginals(counts, keys).groupBy(*keys).agg(
        (F.sum("hits") / F.sum("support")).alias("Accuracy"),
        (F.sum(_f1()) / F.size(labels)).alias("F1ScoreMacro"),
        (F.sum("hits") / F.sum("support")).alias("F1ScoreMicro"),
        (F.sum(F.col("support") * _f1()) / F.sum("support")).alias("WeightedF1Score"),
        _mcc_from_marginals().alias("MCC"),
        (F.sum("ce") / F.sum("support")).alias("CrossEntropyLoss"),
    )
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "metric", "value")


def regression_counts(predictions: DataFrame, keys: list[str], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """(keys, n, sse, sae, mean, sst): one pass; the total sum of squares comes from the stable variance aggregate."""
    error = F.col(y) - F.col(y_hat)
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("sse"), F.sum(F.abs(error)).alias("sae"),
        F.avg(y).alias("mean"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"),
    )


def add_global_regression(counts: DataFrame, client: str = "client_id") -> DataFrame:
    """Adds the Global evaluator from the silos' sums; its total sum of squares is that within plus that between."""
    n, mean = F.col("n"), F.col("mean")
    between = F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / F.sum("n")
    single = F.count(F.lit(1)) == 1
    return with_global(counts, client).groupBy("evaluator").agg(
        F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("sae").alias("sae"),
        (F.sum(n * mean) / F.sum("n")).alias("mean"),
        (F.sum("sst") + F.when(single, F.lit(0.0)).otherwise(F.greatest(between, F.lit(0.0)))).alias("sst"),
    )


def _r2() -> Column:
    constant = F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.col("sst") == 0, constant).otherwise(1 - F.try_divide(F.col("sse"), F.col("sst")))


# Metric names of reports.
REGRESSION: dict[str, Callable[[], Column]] = {
    "RMSE": lambda: F.sqrt(F.col("sse") / F.col("n")),
    "MSE": lambda: F.col("sse") / F.col("n"),
    "RSE": lambda: F.col("sse") / F.col("n"),
    "MAE": lambda: F.col("sae") / F.col("n"),
    "R2": _r2,
}
CLASSIFICATION = ("CrossEntropyLoss", "Accuracy", "F1ScoreMicro", "F1ScoreMacro", "WeightedF1Score", "MCC")
PER_CLASS = "F1Score"


def regression_metric(counts: DataFrame, keys: list[str], metric: str) -> DataFrame:
    return counts.select(*keys, REGRESSION[metric]().alias("value"))


def regression_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    wide = counts.select(*keys, *[build().alias(name) for name, build in REGRESSION.items()])
    return wide.unpivot(keys, list(REGRESSION), "metric", "value")


def evaluate(
    predictions: DataFrame, metrics: list[str], labels: Column | None = None, client: str = "client_id"
) -> DataFrame:
    """(evaluator, metric, class, value) per silo and for Global.

    Predictions with ``probs`` are scored as classes, with ``y_hat`` as numbers. Rows are read once.
    """
    unknown = set(metrics) - set(CLASSIFICATION) - set(REGRESSION) - {PER_CLASS}
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    keys, no_class = ["evaluator"], F.lit(None).cast("string").alias("class")
    if "probs" not in predictions.columns:
        counts = add_global_regression(regression_counts(predictions, [client]), client)
        found = regression_metrics(counts, keys).where(F.col("metric").isin(metrics))
        return found.select("evaluator", "metric", no_class, "value")
    if labels is None:
        raise ValueError("class metrics need the class list")
    counts = add_global(class_counts(predictions, labels, [client]), client)
    if PER_CLASS in metrics:
        counts = control_table(counts)
    parts = []
    if set(metrics) & set(CLASSIFICATION):
        scalar = classification_metrics(counts, keys, labels).where(F.col("metric").isin(metrics))
        parts.append(scalar.select("evaluator", "metric", no_class, "value"))
    if PER_CLASS in metrics:
        listed = f1_per_class(counts, keys, labels).withColumn("metric", F.lit(PER_CLASS))
        parts.append(listed.select("evaluator", "metric", F.col("class").cast("string").alias("class"), "value"))
    return reduce(DataFrame.unionByName, parts)


def direction(metric: str | Column = "metric") -> Column:
    """+1 when larger is better, -1 for losses."""
    m = F.col(metric) if isinstance(metric, str) else metric
    return F.when(m.isin(*LOSSES), F.lit(-1.0)).otherwise(F.lit(1.0))


def metric_delta(left: DataFrame, right: DataFrame, keys: list[str], metric: str = "metric") -> DataFrame:
    """left - right per key, losses turned round so that positive always means better."""
    other = right.withColumnRenamed("value", "_right")
    return left.join(other, keys).select(*keys, (direction(metric) * (F.col("value") - F.col("_right"))).alias("value"))


COMBINERS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


def metric_combine(left: DataFrame, right: DataFrame | float, operation: str, keys: list[str]) -> DataFrame:
    """Metric-wise arithmetic with other metrics or a number."""
    combine = COMBINERS[operation]
    if not isinstance(right, DataFrame):
        return left.select(*keys, combine(F.col("value"), F.lit(float(right))).alias("value"))
    other = right.withColumnRenamed("value", "_right")
    return left.join(other, keys).select(*keys, combine(F.col("value"), F.col("_right")).alias("value"))


def metric_list_combine(left: Column, right: Column, operation: str) -> Column:
    """The same on per-class lists."""
    return F.zip_with(left, right, COMBINERS[operation])


def metric_abs(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.abs("value").alias("value"))


def metric_min_max(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, smaller, larger, sum, difference) of two metric tables."""
    other = right.withColumnRenamed("value", "_right")
    a, b = F.col("value"), F.col("_right")
    return left.join(other, keys).select(
        *keys, F.least(a, b).alias("smaller"), F.greatest(a, b).alias("larger"),
        (a + b).alias("sum"), (a - b).alias("difference"),
    )


def metric_zero(evaluators: DataFrame, metrics: list[str], labels: Column) -> DataFrame:
    """Zero for each requested metric of each evaluator; one zero per class for the per-class metric."""
    scalar = [m for m in metrics if m != PER_CLASS]
    none = F.array(F.lit(None).cast("string"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), none.alias("classes")) for m in scalar])
    zeros = evaluators.select("*", F.explode(cells).alias("m")).select(
        *evaluators.columns, "m.metric", F.explode("m.classes").alias("class"), F.lit(0.0).alias("value")
    )
    if PER_CLASS not in metrics:
        return zeros
    listed = evaluators.select(
        "*", F.lit(PER_CLASS).alias("metric"), F.explode(labels).alias("class"), F.lit(0.0).alias("value")
    )
    return zeros.unionByName(listed.withColumn("class", F.col("class").cast("string")))


def rank_by_accuracy(metrics: DataFrame) -> DataFrame:
    """(evaluator, accuracy, position), best first; ties in evaluator order. The table has one row per silo."""
    scores = metrics.where(F.col("metric") == "Accuracy")
    ranked = scores.agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("loss"), "evaluator"))).alias("a"))
    return ranked.select(F.posexplode("a").alias("p", "s")).select(
        "s.evaluator", (-F.col("s.loss")).alias("accuracy"), (F.col("p") + 1).cast("bigint").alias("position")
    )


def metric_format(metrics: DataFrame, keys: list[str], decimals: int = 6) -> DataFrame:
    """One text per key: ``A:1.0,F1Score:[0.5, 0.25]``, metrics and classes in name order."""
    number = F.format_string(f"%.{decimals}f", F.col("value"))
    lists = metrics.groupBy(*keys, "metric").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.coalesce("class", F.lit("")).alias("c"), number.alias("t")))),
            lambda s: s["t"]), ", ").alias("body"),
        F.max(F.col("class").isNotNull()).alias("listed"),
    )
    body = F.when(F.col("listed"), F.concat(F.lit("["), "body", F.lit("]"))).otherwise(F.col("body"))
    return lists.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("metric", F.lit(":"), body))), ",").alias("text")
    )


METRIC_PATTERN = r"(\w+):(\[[^\]]*\]|[^,\[\]]+)"


def metric_parse(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, metric, position, value) from such texts; scalars have position 0."""
    names = F.regexp_extract_all(F.col(text), F.lit(METRIC_PATTERN), F.lit(1))
    bodies = F.regexp_extract_all(F.col(text), F.lit(METRIC_PATTERN), F.lit(2))
    pairs = texts.select(*keys, F.explode(F.arrays_zip(names.alias("metric"), bodies.alias("body"))).alias("p"))
    numbers = F.split(F.regexp_replace("p.body", r"[\[\] ]", ""), ",")
    return pairs.select(*keys, F.col("p.metric").alias("metric"), F.posexplode(numbers).alias("position", "v")).select(
        *keys, "metric", F.col("position").cast("bigint").alias("position"), F.col("v").cast("double").alias("value")
    )


def final_round_results(evaluation: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Last-round Global value of each metric, one row per experiment."""
    rows = evaluation.where(F.col("evaluator") == GLOBAL)
    return rows.groupBy(*keys).pivot("metric", metrics).agg(F.max_by("value", "round"))

"""Registered queries: evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from silovalue.operators import metrics as M
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query
from silovalue.plans.fixtures import rounded

KEY = ["evaluator"]


def _metric(name: str, compute, metric: str) -> None:
    @query(name, f"SELECT evaluator, round(value, 6) AS value FROM scalar_metrics WHERE metric = '{metric}'")
    def run(spark, d):
        counts, labels = fx.counts(spark, d)
        return rounded(compute(counts, labels))


@query("confusion_counts", "SELECT evaluator, label, predicted, n FROM confusion")
def confusion_counts(spark, d):
    return M.confusion_counts(fx.counts(spark, d)[0], KEY)


_metric("cross_entropy_loss", lambda c, l: M.cross_entropy_loss(c, KEY), "CrossEntropyLoss")
_metric("accuracy", lambda c, l: M.accuracy(c, KEY), "Accuracy")
_metric("f1_micro", lambda c, l: M.f1_micro(c, KEY), "F1ScoreMicro")
_metric("f1_macro", lambda c, l: M.f1_macro(c, KEY, l), "F1ScoreMacro")
_metric("f1_weighted", lambda c, l: M.f1_weighted(c, KEY), "WeightedF1Score")
_metric("mcc", lambda c, l: M.mcc(c, KEY), "MCC")


@query("f1_per_class", "SELECT evaluator, class, round(value, 6) AS value FROM f1_table")
def f1_per_class(spark, d):
    counts, labels = fx.counts(spark, d)
    return rounded(M.f1_per_class(counts, KEY, labels))


REGRESSION_SQL = {
    "RMSE": "sqrt(avg((y - y_hat) ** 2))", "MSE": "avg((y - y_hat) ** 2)", "RSE": "avg((y - y_hat) ** 2)",
    "MAE": "avg(abs(y - y_hat))",
    "R2": "CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - y_hat) ** 2) = 0 THEN 1 ELSE 0 END "
          "ELSE 1 - avg((y - y_hat) ** 2) / var_pop(y) END",
}
DIGITS = {"RMSE": 4, "MSE": 0, "RSE": 0, "MAE": 4, "R2": 6}


def _regression(name: str, metric: str) -> None:
    @query(name, f"""
SELECT evaluator, round({REGRESSION_SQL[metric]}, {DIGITS[metric]}) AS value
FROM regression_evaluated GROUP BY evaluator""")
    def run(spark, d):
        return rounded(M.regression_metric(fx.regression_counts(spark, d), KEY, metric), DIGITS[metric])


for _name, _m in (("rmse", "RMSE"), ("mse", "MSE"), ("rse", "RSE"), ("mae", "MAE"), ("r2", "R2")):
    _regression(_name, _m)


@query("evaluate", """
SELECT evaluator, metric, NULL::VARCHAR AS class, round(value, 6) AS value FROM scalar_metrics
UNION ALL SELECT evaluator, 'F1Score', class, round(value, 6) FROM f1_table""")
def evaluate(spark, d):
    model = fx.EventModel(spark, d)
    return rounded(M.evaluate(fx.predictions(spark, d, model), [*M.CLASSIFICATION, M.PER_CLASS], model.labels))


@query("evaluate_regression", f"""
SELECT evaluator, 'MAE' AS metric, round({REGRESSION_SQL['MAE']}, 4) AS value FROM regression_evaluated GROUP BY evaluator
UNION ALL SELECT evaluator, 'R2', round({REGRESSION_SQL['R2']}, 4) FROM regression_evaluated GROUP BY evaluator""")
def evaluate_regression(spark, d):
    return rounded(M.evaluate(fx.regression_predictions(spark, d), ["MAE", "R2"]).drop("class"), 4)


DELTA = """
SELECT a.evaluator, a.metric, {expr} FROM scalar_metrics a
JOIN scalar_metrics g ON g.evaluator = 'Global' AND g.metric = a.metric WHERE a.evaluator <> 'Global'"""


def _own_and_global(spark, d):
    """Scalar metrics of each silo, and those of Global under every silo's name."""
    counts, labels = fx.counts(spark, d)
    every = M.classification_metrics(counts, KEY, labels)
    own = every.where(F.col("evaluator") != M.GLOBAL)
    pooled = every.where(F.col("evaluator") == M.GLOBAL).select("metric", "value")
    return own, own.select("evaluator", "metric").join(pooled, "metric")


@query("metric_delta", DELTA.format(
    expr="round(CASE WHEN a.metric = 'CrossEntropyLoss' THEN -1 ELSE 1 END * (a.value - g.value), 6) AS value"))
def metric_delta(spark, d):
    own, pooled = _own_and_global(spark, d)
    return rounded(M.metric_delta(own, pooled, ["evaluator", "metric"]))


@query("metric_combine", DELTA.format(
    expr="round(abs((a.value + g.value) * 2 / 3 - g.value * a.value), 6) AS value"))
def metric_combine(spark, d):
    own, pooled = _own_and_global(spark, d)
    keys = ["evaluator", "metric"]
    scaled = M.metric_combine(M.metric_combine(M.metric_combine(own, pooled, "add", keys), 2, "multiply", keys), 3, "divide", keys)
    product = M.metric_combine(own, pooled, "multiply", keys)
    return rounded(M.metric_abs(M.metric_combine(scaled, M.metric_combine(product, -1, "multiply", keys), "add", keys), keys))


@query("metric_list_combine", """
SELECT a.evaluator, list(round(a.value + g.value, 6) ORDER BY a.class) AS value FROM f1_table a
JOIN f1_table g ON g.evaluator = 'Global' AND g.class = a.class WHERE a.evaluator <> 'Global' GROUP BY a.evaluator""")
def metric_list_combine(spark, d):
    counts, labels = fx.counts(spark, d)
    lists = M.f1_per_class(counts, KEY, labels).groupBy("evaluator").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "value"))), lambda s: s["value"]).alias("value")
    )
    pooled = lists.where(F.col("evaluator") == M.GLOBAL).select("value").scalar()
    both = M.metric_list_combine(F.col("value"), F.col("pooled"), "add")
    return lists.where(F.col("evaluator") != M.GLOBAL).withColumn("pooled", pooled).select(
        "evaluator", F.transform(both, lambda x: F.round(x, 6)).alias("value")
    )


@query("metric_min_max", DELTA.format(expr="""round(least(a.value, g.value), 6) AS smaller,
round(greatest(a.value, g.value), 6) AS larger, round(a.value + g.value, 6) AS sum, round(a.value - g.value, 6) AS difference"""))
def metric_min_max(spark, d):
    own, pooled = _own_and_global(spark, d)
    return rounded(M.metric_min_max(own, pooled, ["evaluator", "metric"]))


@query("metric_zero", """
SELECT evaluator, metric, NULL::VARCHAR AS class, 0.0::DOUBLE AS value
FROM (SELECT DISTINCT CAST(client_id AS VARCHAR) AS evaluator FROM silo_events)
CROSS JOIN (SELECT unnest(['Accuracy', 'CrossEntropyLoss']) AS metric)
UNION ALL SELECT evaluator, 'F1Score', label, 0.0::DOUBLE
FROM (SELECT DISTINCT CAST(client_id AS VARCHAR) AS evaluator FROM silo_events) CROSS JOIN class_names""")
def metric_zero(spark, d):
    model = fx.EventModel(spark, d)
    silos = model.silos.select(F.col("client_id").cast("string").alias("evaluator"))
    return M.metric_zero(silos, ["Accuracy", "CrossEntropyLoss", M.PER_CLASS], model.labels)


@query("rank_by_accuracy", """
SELECT evaluator, round(value, 6) AS accuracy, row_number() OVER (ORDER BY value DESC, evaluator) AS position
FROM scalar_metrics WHERE metric = 'Accuracy'""")
def rank_by_accuracy(spark, d):
    counts, labels = fx.counts(spark, d)
    return rounded(M.rank_by_accuracy(M.classification_metrics(counts, KEY, labels)))


FORMAT_SQL = """
SELECT evaluator, string_agg(metric || ':' || body, ',' ORDER BY metric) AS text FROM (
  SELECT evaluator, metric, format('{:.3f}', value) AS body FROM scalar_metrics WHERE metric IN ('Accuracy', 'MCC')
  UNION ALL SELECT evaluator, 'F1Score', '[' || string_agg(format('{:.3f}', value), ', ' ORDER BY class) || ']'
  FROM f1_table GROUP BY evaluator) GROUP BY evaluator"""


def _texts(spark, d):
    model = fx.EventModel(spark, d)
    found = M.evaluate(fx.predictions(spark, d, model), ["Accuracy", "MCC", M.PER_CLASS], model.labels)
    return M.metric_format(found, KEY, 3)


@query("metric_format", FORMAT_SQL)
def metric_format(spark, d):
    return _texts(spark, d)


@query("metric_parse", """
SELECT evaluator, metric, 0::BIGINT AS position, round(value, 3) AS value FROM scalar_metrics WHERE metric IN ('Accuracy', 'MCC')
UNION ALL SELECT evaluator, 'F1Score', row_number() OVER (PARTITION BY evaluator ORDER BY class) - 1, round(value, 3)
FROM f1_table""")
def metric_parse(spark, d):
    return rounded(M.metric_parse(_texts(spark, d), KEY))


@query("final_round_results", """
SELECT round(max(value) FILTER (WHERE metric = 'Accuracy'), 6) AS "Accuracy",
       round(max(value) FILTER (WHERE metric = 'CrossEntropyLoss'), 6) AS "CrossEntropyLoss",
       round(max(value) FILTER (WHERE metric = 'MCC'), 6) AS "MCC", 'events' AS experiment
FROM round_evaluation WHERE evaluator = 'Global' AND round = 3""")
def final_round_results(spark, d):
    names = ["Accuracy", "CrossEntropyLoss", "MCC"]
    evaluation = fx.round_evaluation(fx.round_utility(fx.round_model(spark, d), names)).withColumn("experiment", F.lit("events"))
    return rounded(M.final_round_results(evaluation, ["experiment"], names))

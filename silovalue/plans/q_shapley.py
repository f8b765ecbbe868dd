"""Registered queries: coalitions, Shapley values, gradient rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from silovalue.operators import shapley as S
from silovalue.plans import fixtures as fx
from silovalue.plans.catalog import query
from silovalue.plans.fixtures import rounded


def _models(model: fx.EventModel):
    """Coalition models of the event silos."""
    return S.coalition_models(model.params(), ["bucket", "label"], model.silos)


@query("coalitions", "SELECT mask, count(*) AS size FROM member_table GROUP BY mask")
def coalitions(spark, d):
    return S.coalitions(fx.EventModel(spark, d).silos)


@query("coalition_models", "SELECT mask, bucket, label, round(value, 6) AS value FROM lattice_models")
def coalition_models(spark, d):
    return rounded(_models(fx.EventModel(spark, d)))


@query("coalition_utility", "SELECT evaluator, mask, metric, class, round(value, 6) AS value FROM lattice_utility")
def coalition_utility(spark, d):
    model = fx.EventModel(spark, d)
    return rounded(S.coalition_utility(_models(model), model.test, fx.UTILITY_METRICS, model.labels))


SV_SQL = """
SELECT {keys}p.client_id, round(sum((coalesce(o.value, ln((SELECT count(*) FROM class_names))) - w.value)
  * factorial(CAST(bit_count(w.mask) - 1 AS INTEGER))::DOUBLE * factorial(CAST(players - bit_count(w.mask) AS INTEGER))::DOUBLE
  / factorial(CAST(players AS INTEGER))::DOUBLE), 6) AS value
FROM lattice_utility w JOIN player_list p ON (w.mask >> p.pos) & 1 = 1
LEFT JOIN lattice_utility o ON o.mask = w.mask - (1 << CAST(p.pos AS INTEGER)) AND o.evaluator = w.evaluator AND o.metric = w.metric
WHERE w.metric = 'CrossEntropyLoss' AND {filter} GROUP BY ALL"""


def _loss_values(spark, d, chosen):
    model = fx.EventModel(spark, d)
    utility = S.coalition_utility(_models(model), model.test, ["CrossEntropyLoss"], model.labels).drop("class")
    guess = F.ln(F.size(model.labels).cast("double"))
    return rounded(S.shapley_values(utility.where(chosen), model.silos, guess, ["evaluator", "metric"]))


def flagship(spark, d):
    """Which silo adds most to predicting the event type? Shapley value of cross entropy on all test rows."""
    return _loss_values(spark, d, F.col("evaluator") == "Global").select("client_id", "value")


query("shapley_values", SV_SQL.format(keys="", filter="w.evaluator = 'Global'"))(flagship)


@query("shapley_by_evaluator", SV_SQL.format(keys="w.evaluator, ", filter="w.evaluator <> 'Global'"))
def shapley_by_evaluator(spark, d):
    return _loss_values(spark, d, F.col("evaluator") != "Global").select("evaluator", "client_id", "value")

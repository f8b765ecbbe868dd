"""Exact Shapley values over the lattice of silo coalitions.

A coalition is a bit mask over the sorted silo list. All coalitions of all evaluators are scored in one job on counted
test rows; the value of a silo is one weighted sum over coalition utilities, so no lattice self-join is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from silovalue.functions import arrays
from silovalue.functions.lineage import control_table, small_side
from silovalue.operators import metrics as M
from silovalue.operators.combine import aggregate_f1
from silovalue.operators.count_model import average_parameters, distinct_list

MAX_PLAYERS = 12


def players(df: DataFrame, client: str = "client_id") -> DataFrame:
    """One row with the sorted silo list; more than 12 silos are refused (2^n coalitions)."""
    return distinct_list(df, client, MAX_PLAYERS)


def coalition_members(df: DataFrame, client: str = "client_id") -> DataFrame:
    """(mask, client_id): the members of every non-empty coalition of the silos in ``df``."""
    lists = players(df, client)
    full = F.pow(F.lit(2.0), F.size("a")).cast("bigint") - 1
    masks = lists.select("a", F.explode(F.sequence(F.lit(1).cast("bigint"), full)).alias("mask"))
    return masks.select("mask", F.posexplode("a").alias("p", client)).where(
        F.getbit("mask", F.col("p")) == 1
    ).select("mask", client)


def coalitions(df: DataFrame, client: str = "client_id") -> DataFrame:
    """(mask, size) of every non-empty coalition."""
    return coalition_members(df, client).groupBy("mask").agg(F.count(F.lit(1)).alias("size"))


def coalition_models(
    params: DataFrame, positions: list[str], silos: DataFrame | None = None, client: str = "client_id"
) -> DataFrame:
    """Parameters of each coalition: the weighted average of its members' parameters.

    The lattice is dealt by coalition before the parameters join, so its fan-out runs in as many tasks as there are.
    """
    members = coalition_members(params if silos is None else silos, client).repartition("mask")
    return average_parameters(members.join(small_side(params), client), positions, ["mask"])


def coalition_counts(models: DataFrame, test_counts: DataFrame, labels: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """(evaluator, mask, label, predicted, n, ce) of every coalition on every silo's test rows and on their union.

    ``test_counts`` is (client_id, bucket, label, n): the fan-out over coalitions is over counted cells, not over rows.
    """
    vectors = models.groupBy(*extra, "mask", "bucket").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("label", "value"))), lambda s: s["value"]).alias("probs")
    )
    evaluated = M.with_global(test_counts).groupBy("evaluator", "bucket", "label").agg(F.sum("n").alias("n"))
    scored = evaluated.join(vectors, "bucket").select(
        *extra, "evaluator", "mask", "label", "n",
        F.element_at(labels, arrays.argmax(F.col("probs")) + 1).alias("predicted"),
        M.cross_entropy(F.element_at("probs", F.array_position(labels, F.col("label")).cast("int"))).alias("_ce"),
    )
    return scored.groupBy(*extra, "evaluator", "mask", "label", "predicted").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_ce")).alias("ce")
    )


def utilities(counts: DataFrame, metric_names: list[str], labels: Column, keys: list[str]) -> DataFrame:
    """(keys, metric, class, value) from coalition counts."""
    none = F.lit(None).cast("string")
    if metric_names == ["CrossEntropyLoss"]:
        loss = M.cross_entropy_loss(counts, keys)
        return loss.select(*keys, F.lit("CrossEntropyLoss").alias("metric"), none.alias("class"), "value")
    parts = []
    if set(metric_names) & set(M.CLASSIFICATION):
        scalar = M.classification_metrics(counts, keys, labels).where(F.col("metric").isin(metric_names))
        parts.append(scalar.select(*keys, "metric", none.alias("class"), "value"))
    if M.PER_CLASS in metric_names:
        listed = M.f1_per_class(counts, keys, labels).withColumn("metric", F.lit(M.PER_CLASS))
        parts.append(listed.select(*keys, "metric", F.col("class").cast("string").alias("class"), "value"))
    return reduce(DataFrame.unionByName, parts)


def coalition_utility(
    models: DataFrame, test_counts: DataFrame, metric_names: list[str], labels: Column, extra: tuple[str, ...] = ()
) -> DataFrame:
    """(evaluator, mask, metric, class, value): every metric of every coalition on every test set, in one job."""
    counts = coalition_counts(models, test_counts, labels, extra)
    if M.PER_CLASS in metric_names:
        counts = control_table(counts)
    return utilities(counts, metric_names, labels, [*extra, "evaluator", "mask"])


def _weight(size: Column, n: Column) -> Column:
    """(s-1)! (n-s)! / n! of a coalition of size s that contains the silo."""
    fact = lambda c: F.factorial(c.cast("int")).cast("double")
    return fact(size - 1) * fact(n - size) / fact(n)


def shapley_values(
    utility: DataFrame, clients: DataFrame, empty: DataFrame | Column, keys: list[str], metric: str | Column = "metric"
) -> DataFrame:
    """(keys, client_id, value) from coalition utilities (keys, mask, value).

    φ_i = Σ_{S∋i} w(|S|) v(S) − Σ_{S∌i} w(|S|+1) v(S). The empty coalition enters as ``empty``, a column or a table
    (keys, value) such as last round's global result. Losses are turned round, so a positive value is a gain.
    """
    zero = F.lit(0).cast("bigint")
    rows = utility.select(*keys, F.col("mask").cast("bigint").alias("mask"), "value")
    if isinstance(empty, DataFrame):
        start = empty.select(*keys, zero.alias("mask"), "value")
    else:
        start = rows.where(F.col("mask") == 1).select(*keys, zero.alias("mask"), empty.cast("double").alias("value"))
    lists = players(clients).scalar()
    n = F.size(lists)
    size = F.bit_count("mask")
    fanned = rows.unionByName(start).select("*", F.posexplode(lists).alias("p", "client_id"))
    inside = F.getbit("mask", F.col("p")) == 1
    term = F.when(inside, _weight(size, n)).otherwise(-_weight(size + 1, n)) * F.col("value")
    sign = M.direction(metric) if isinstance(metric, str) and metric in keys else (
        F.lit(1.0) if isinstance(metric, str) else metric
    )
    return fanned.groupBy(*keys, "client_id").agg(F.sum(sign * term).alias("value"))


def shapley_aggregated(
    sv: DataFrame, shares: DataFrame, by_class: DataFrame | None, keys: list[str], squared_rmse: bool = False
) -> DataFrame:
    """Evaluator values combined with training shares: by class for the per-class metric, by rows otherwise.

    ``squared_rmse`` squares RMSE values before weighting and does not root them, as published results did.
    """
    value = F.when(F.col("metric") == "RMSE", F.col("value") * F.col("value")).otherwise(F.col("value"))
    rows = sv.withColumn("value", value) if squared_rmse else sv
    own = shares.withColumnRenamed("client_id", "_evaluator_id").withColumn(
        "evaluator", F.col("_evaluator_id").cast("string")
    ).select("evaluator", "share")
    if by_class is None:
        return rows.join(own, "evaluator").groupBy(*keys).agg(F.sum(F.col("share") * F.col("value")).alias("value"))
    scalar = rows.where(F.col("metric") != M.PER_CLASS).join(own, "evaluator").groupBy(*keys).agg(
        F.sum(F.col("share") * F.col("value")).alias("value")
    )
    listed = aggregate_f1(rows.where(F.col("metric") == M.PER_CLASS), by_class, keys)
    return scalar.withColumn("class", F.lit(None).cast("string")).unionByName(listed)


def shapley_totals(sv: DataFrame, keys: list[str]) -> DataFrame:
    return sv.groupBy(*keys).agg(F.sum("value").alias("value"))


def shapley_round_mean(sv: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over all rounds but the last."""
    last = sv.agg(F.max("round")).scalar()
    return sv.where(F.col("round") < last).groupBy(*keys).agg(F.avg("value").alias("value"))


def tree_coalition_scores(base: DataFrame, member_scores: DataFrame, keys: list[str]) -> DataFrame:
    """(mask, keys, class, score): base ensemble plus the members' trees; scores of trees add up.

    ``base`` is (keys, class, score) of last round's ensemble, ``member_scores`` is (client_id, keys, class, score) of
    this round's trees per silo.
    """
    fanned = member_scores.join(coalition_members(member_scores), "client_id").groupBy("mask", *keys, "class").agg(
        F.sum("score").alias("added")
    )
    return fanned.join(base, [*keys, "class"]).select(
        "mask", *keys, "class", (F.col("score") + F.col("added")).alias("score")
    )

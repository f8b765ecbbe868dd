"""Combining what the silos report: weighted metrics, averaged parameters, pooled trees, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from silovalue.functions import arrays
from silovalue.operators.metrics import PER_CLASS, cross_entropy

SQUARED = ("RMSE",)


def train_shares(profile: DataFrame, split: str = "train") -> DataFrame:
    """(client_id, share) of all training rows, from the partition profile."""
    sizes = profile.where(F.col("split") == split).groupBy("client_id").agg(F.sum("n").alias("n"))
    everything = sizes.agg(F.sum("n")).scalar()
    return sizes.select("client_id", (F.col("n") / everything).alias("share"))


def class_shares(profile: DataFrame, split: str = "train") -> DataFrame:
    """(client_id, class, share) of the training rows of each class; null for a class nobody has."""
    rows = profile.where(F.col("split") == split)
    totals = rows.groupBy("label").agg(F.sum("n").alias("total"))
    return rows.join(totals, "label").select(
        "client_id", F.col("label").alias("class"), F.try_divide("n", "total").alias("share")
    )


def weighted_loss(losses: DataFrame, keys: list[str]) -> DataFrame:
    """Σ n·loss / Σ n over the silos' test rows."""
    return losses.groupBy(*keys).agg((F.sum(F.col("n") * F.col("loss")) / F.sum("n")).alias("value"))


def aggregate_metric(values: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """Scalar metrics weighted by the silo's share of the training rows."""
    weighted = values.join(shares.withColumn("evaluator", F.col("client_id").cast("string")).drop("client_id"), "evaluator")
    return weighted.groupBy(*keys).agg(F.sum(F.col("share") * F.col("value")).alias("value"))


def aggregate_f1(values: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """Per-class values weighted by the silo's share of that class."""
    named = shares.withColumn("evaluator", F.col("client_id").cast("string")).drop("client_id")
    return values.join(named, ["evaluator", "class"]).groupBy(*keys, "class").agg(
        F.coalesce(F.sum(F.col("share") * F.col("value")), F.lit(0.0)).alias("value")
    )


def aggregate_rmse(values: DataFrame, shares: DataFrame, keys: list[str], plain: bool = False) -> DataFrame:
    """Root of the weighted mean square; ``plain`` is the direct weighted mean of the tree strategy."""
    if plain:
        return aggregate_metric(values, shares, keys)
    squared = values.withColumn("value", F.col("value") * F.col("value"))
    return aggregate_metric(squared, shares, keys).withColumn("value", F.sqrt("value"))


def aggregate_all(
    values: DataFrame, shares: DataFrame, by_class: DataFrame, keys: list[str], squared_rmse: bool = True
) -> DataFrame:
    """Each metric by its own rule: F1 by class share, RMSE by squares, everything else by training share."""
    scalar = values.where(F.col("metric") != PER_CLASS)
    if squared_rmse:
        plain = aggregate_metric(scalar.where(~F.col("metric").isin(*SQUARED)), shares, keys)
        rooted = aggregate_rmse(scalar.where(F.col("metric").isin(*SQUARED)), shares, keys)
        plain = plain.unionByName(rooted)
    else:
        plain = aggregate_metric(scalar, shares, keys)
    listed = aggregate_f1(values.where(F.col("metric") == PER_CLASS), by_class, keys)
    return plain.withColumn("class", F.lit(None).cast("string")).unionByName(listed)


def bag_trees(base: DataFrame | None, clients: DataFrame) -> DataFrame:
    """Appends this round's trees of every silo to the ensemble and numbers them on.

    ``clients`` has one row per tree node or leaf with (client_id, tree_id, …); ids are re-numbered per silo block by a
    running sum over the small table of tree counts. The class of a tree stays as it is.
    """
    start = F.lit(0) if base is None else F.coalesce(base.agg(F.max("tree_id") + 1).scalar(), F.lit(0))
    counts = clients.groupBy("client_id").agg((F.max("tree_id") + 1).alias("trees"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("client_id", "trees"))).alias("a"))
    before = F.aggregate(
        F.slice(F.col("a"), 1, F.col("p")), F.lit(0).cast("bigint"), lambda s, x: s + x["trees"]
    )
    offsets = listed.select("a", F.posexplode("a").alias("p", "s")).select(
        F.col("s.client_id").alias("client_id"), before.alias("offset")
    )
    added = clients.join(offsets, "client_id").withColumn(
        "tree_id", (F.col("tree_id") + F.col("offset") + start).cast("bigint")
    ).drop("offset")
    return added if base is None else base.unionByName(added)


def ensemble_average(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Mean of several models' outputs per row and class."""
    return scores.groupBy(*keys).agg(F.avg(value).alias(value))


def average_vectors(vectors: list[Column]) -> Column:
    """Mean of score vectors that stand side by side in one row: no shuffle."""
    first, *rest = vectors
    summed = first
    for v in rest:
        summed = F.zip_with(summed, v, lambda a, b: a + b)
    return F.transform(summed, lambda x: x / len(vectors))


def ensemble_evaluate(rows: DataFrame, outputs: list[str], labels: Column, keys: list[str], label: str = "label") -> DataFrame:
    """Softmax of each model's output, their mean, then mean cross entropy and accuracy, all inside one aggregation."""
    mean = average_vectors([arrays.softmax(F.col(o)) for o in outputs])
    scored = rows.select(*keys, F.array_position(labels, F.col(label)).cast("int").alias("true"), mean.alias("p"))
    hit = F.when(arrays.argmax(F.col("p")) + 1 == F.col("true"), F.lit(1.0)).otherwise(F.lit(0.0))
    return scored.groupBy(*keys).agg(
        F.avg(cross_entropy(F.element_at("p", F.col("true")))).alias("loss"), F.avg(hit).alias("accuracy")
    )


def scale_rate_by_share(profile: DataFrame, rate: float) -> DataFrame:
    """Learning rate of each silo × its share of the training rows."""
    return train_shares(profile).select("client_id", (F.lit(rate) * F.col("share")).alias("rate"))


def previous_round(values: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the value of the round before; the window runs over rounds of one metric only."""
    order = Window.partitionBy(*keys).orderBy("round")
    return values.withColumn("previous", F.lag("value").over(order))

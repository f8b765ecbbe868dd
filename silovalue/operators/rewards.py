"""Gradient rewards: how well a silo's gradient agrees with the weighted gradient of all silos.

Gradients are long tables (client_id, position…, value), so a vector never has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def normalize(gradients: DataFrame, by: list[str]) -> DataFrame:
    """Each gradient divided by its norm; a zero gradient stays zero."""
    norms = gradients.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return gradients.join(norms, by).withColumn(
        "value", F.coalesce(F.try_divide("value", "norm"), F.lit(0.0))
    ).drop("norm")


def gradient_reward(
    gradients: DataFrame, sizes: DataFrame, positions: list[str], by: tuple[str, ...] = ()
) -> DataFrame:
    """(by, client_id, value): cosine between the size-weighted sum of unit gradients and the silo's own gradient."""
    unit = normalize(gradients, [*by, "client_id"])
    pooled = unit.join(sizes, "client_id").groupBy(*by, *positions).agg(
        F.sum(F.col("n") * F.col("value")).alias("pooled")
    )
    total = F.sum(F.col("pooled") * F.col("pooled")).alias("all")
    length = pooled.groupBy(*by).agg(total) if by else pooled.agg(total)
    sums = unit.join(pooled, [*by, *positions]).groupBy(*by, "client_id").agg(
        F.sum(F.col("value") * F.col("pooled")).alias("dot"), F.sum(F.col("value") * F.col("value")).alias("own")
    )
    sums = sums.join(length, list(by)) if by else sums.withColumn("all", length.scalar())
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("own") * F.col("all"))), F.lit(0.0))
    return sums.select(*by, "client_id", cosine.alias("value"))


def gradient_reward_running(rewards: DataFrame, by: tuple[str, ...] = ("round",)) -> DataFrame:
    """Running mean of the rewards in silo order, as published results hold it."""
    order = Window.partitionBy(*by).orderBy("client_id").rowsBetween(Window.unboundedPreceding, 0)
    return rewards.withColumn("value", F.avg("value").over(order))


def gradient_reward_totals(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("client_id").agg(F.sum("value").alias("value"))

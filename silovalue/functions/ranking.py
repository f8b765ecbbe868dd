"""Exact ranks and running sums without a one-task sort.

A window over one group would sort the whole group in one task. Here the group is cut into buckets that follow the sort
order; bucket totals give every bucket its starting offset, and only rows of one bucket are sorted together.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from silovalue.functions.hashing import row_hash

BUCKETS_PER_PARTITION = 64


def _with_offsets(df: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """Adds ``_offset``, the weight before the row's bucket in its group; null groups and buckets are kept as such."""
    keys = [*group, "_bucket"]
    sizes = df.groupBy(*keys).agg(F.sum(weight).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_o_{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_o_{i}")) for i, k in enumerate(keys)]
    return df.join(offsets, same).drop(*[f"_o_{i}" for i in range(len(keys))])


def hash_rank(
    df: DataFrame, group: list[str], id_col: str, seed: int, name: str = "rank", digits: int | None = None
) -> DataFrame:
    """Adds the 0-based random rank of each row in its group, ordered by (hash, id).

    Rows are bucketed by the first hash digits, so a bucket holds a 16^-digits share of its group however the ids lie.
    By default there are at least 64 buckets per shuffle partition of the session.
    """
    if digits is None:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        digits = max(2, math.ceil(math.log(BUCKETS_PER_PARTITION * width, 16)))
    hashed = df.withColumn("_hash", row_hash(seed, id_col)).withColumn("_bucket", F.substring("_hash", 1, digits))
    group = group or ["_all"]
    if group == ["_all"]:
        hashed = hashed.withColumn("_all", F.lit(0))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", id_col)
    ranked = _with_offsets(hashed, group, F.lit(1)).withColumn(
        name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("bigint")
    )
    return ranked.drop("_hash", "_bucket", "_offset", "_all")


def quantile_bounds(df: DataFrame, columns: list[str], buckets: int) -> list[list[float]]:
    """Bucket borders per column that follow the data, from one pass; nulls and NaN have no part in them.

    There is at least one bucket for each shuffle partition of the session, so a bucket is no more than what the session
    means a task to sort. Borders steer the balance only: ranks are exact whatever they are.
    """
    count = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probabilities = [i / count for i in range(1, count)]
    numbers = {c: F.col(c).cast("double") for c in columns}
    found = df.agg(*[
        F.percentile_approx(F.when(~F.isnan(v), v), probabilities, 10 * count).alias(c) for c, v in numbers.items()
    ]).first()
    return [sorted(set(found[c] or [])) for c in columns]


def quantile_bucket(df: DataFrame, columns: list[str], names: list[str], buckets: int = 256) -> DataFrame:
    """Adds an order-preserving bucket number for each numeric column: nulls in bucket -1, NaN in the one after the last."""
    inner = quantile_bounds(df, columns, buckets)
    typed = df.withColumns({f"_d_{n}": F.col(c).cast("double") for c, n in zip(columns, names)})
    bucketizer = Bucketizer(
        inputCols=[f"_d_{n}" for n in names],
        outputCols=names,
        splitsArray=[[-float("inf"), *b, float("inf")] if b else [-float("inf"), 0.0, float("inf")] for b in inner],
        handleInvalid="keep",
    )
    whole = {n: F.coalesce(F.col(n).cast("int"), F.lit(-1)) for n in names}
    return bucketizer.transform(typed).withColumns(whole).drop(*[f"_d_{n}" for n in names])


def ordered_rank(
    df: DataFrame, group: list[str], key: str, name: str = "rank", bucket: str | None = None
) -> DataFrame:
    """Adds the 0-based rank of each row by a unique numeric key inside its group.

    ``bucket`` is an order-preserving bucket column; without it quantile buckets of the key are made.
    """
    bucketed = df.withColumnRenamed(bucket, "_bucket") if bucket else quantile_bucket(df, [key], ["_bucket"])
    if not group:
        bucketed = bucketed.withColumn("_all", F.lit(0))
    keys = group or ["_all"]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(key)
    ranked = _with_offsets(bucketed, keys, F.lit(1)).withColumn(
        name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("bigint")
    )
    return ranked.drop("_bucket", "_offset", "_all")


def cumulative_counts(df: DataFrame, group: list[str], value: str, bucket: str | None = None) -> DataFrame:
    """(group, value, n, upto): rows per distinct value and the number of rows up to and including it.

    Equal values are counted together first, so a value that fills a third of the table is one row here. ``bucket`` is
    an order-preserving bucket column; without it quantile buckets are made.
    """
    if bucket is None:
        df, bucket = quantile_bucket(df, [value], ["_bucket"]), "_bucket"
    counted = df.groupBy(*group, F.col(bucket).alias("_bucket"), value).agg(F.count(F.lit(1)).alias("n"))
    if not group:
        counted = counted.withColumn("_all", F.lit(0))
    keys = group or ["_all"]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    return (
        _with_offsets(counted, keys, F.col("n"))
        .withColumn("upto", (F.col("_offset") + F.sum("n").over(inside)).cast("bigint"))
        .drop("_bucket", "_offset", "_all")
    )

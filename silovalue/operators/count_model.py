"""Class model by counting: P(label | bucket) with add-one smoothing, one model per silo.

Its parameters average like network weights, which makes every federated operator checkable in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from silovalue.functions.lineage import control_table, small_side

MAX_CLASSES = 10_000
CELL_LIMIT = 200_000


def distinct_list(df: DataFrame, column: str, limit: int = MAX_CLASSES) -> DataFrame:
    """One row with the sorted distinct values of a column; refuses more than ``limit`` of them."""
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1)
    return values.agg(F.array_sort(F.collect_list("v")).alias("a")).select(
        F.when(F.size("a") > limit, F.raise_error(F.lit(f"more than {limit} values of {column}")))
        .otherwise(F.col("a")).alias("a")
    )


def literal_list(df: DataFrame, column: str, limit: int = MAX_CLASSES) -> Column:
    """The sorted distinct values of a small counted table as an array literal."""
    rows = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values of {column}")
    return F.array(*[F.lit(v) for v in sorted(r.v for r in rows)])


def literal_lists(df: DataFrame, columns: list[str], limit: int = MAX_CLASSES) -> list[Column]:
    """The sorted distinct values of several columns of a counted table as array literals, in one action.

    The sets are taken over a bounded number of cells; a larger table is asked column by column.
    """
    cells = df.select(*columns).limit(CELL_LIMIT + 1)
    found = cells.agg(F.count(F.lit(1)).alias("_n"), *[F.collect_set(c).alias(c) for c in columns]).first()
    if found["_n"] > CELL_LIMIT:
        return [literal_list(df, c, limit) for c in columns]
    if any(len(found[c]) > limit for c in columns):
        raise ValueError(f"more than {limit} values in one of {columns}")
    return [F.array(*[F.lit(v) for v in sorted(found[c])]) for c in columns]


def count_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) as a checkpointed table.

    One scan with a map-side combine; every later step of a valuation works on these counts, so the rows are read once
    however many models, coalitions and evaluators follow.
    """
    return control_table(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def fit_per_client(
    counts: DataFrame, labels: Column, buckets: Column, client: str = "client_id", bucket: str = "bucket",
    label: str = "label", extra: tuple[str, ...] = (),
) -> DataFrame:
    """(client, bucket, label, value, n_examples) for every silo × bucket × class, absent combinations included.

    ``counts`` holds the training rows as (client, bucket, label, n).
    """
    seen = counts.groupBy(*extra, client, bucket, label).agg(F.sum("n").alias("k"))
    sizes = seen.groupBy(*extra, client).agg(F.sum("k").alias("n_examples"))
    grid = sizes.withColumn(bucket, F.explode(buckets)).withColumn(label, F.explode(labels))
    totals = Window.partitionBy(*extra, client, bucket)
    k = F.coalesce(F.col("k"), F.lit(0))
    return grid.join(seen, [*extra, client, bucket, label], "left").select(
        *extra, client, bucket, label,
        ((k + 1) / (F.sum(k).over(totals) + F.size(labels))).alias("value"), "n_examples",
    )


def average_parameters(
    params: DataFrame, positions: list[str], by: list[str] | None = None, weight: str = "n_examples"
) -> DataFrame:
    """Σ n·w / Σ n per weight position (and per ``by`` key, such as a coalition)."""
    return params.groupBy(*(by or []), *positions).agg(
        (F.sum(F.col(weight) * F.col("value")) / F.sum(weight)).alias("value")
    )


def predict(rows: DataFrame, params: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Adds ``probs``, the class probabilities in sorted class order, by an equi-join on the model keys."""
    vectors = params.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(label, "value"))), lambda s: s["value"]).alias("probs")
    )
    return rows.join(small_side(vectors), keys)

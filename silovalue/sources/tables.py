"""Scans and sinks: raw CSV, partitioned silo tables, wide result matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def dataset(name: str):
    """Registers a loader under a name, so that a run can pick its data by configuration."""

    def register(loader):
        DATASETS[name] = loader
        return loader

    return register


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header CSV with an explicit schema: no second pass to infer types."""
    return spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, escape='"')


def sink_partition(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One Parquet table per scheme, partitioned by silo and split. ``mode='ignore'`` keeps an existing scheme.

    The rebalance hint lets adaptive execution split a silo that holds a third of the table over many writers and put
    small silos together.
    """
    spread = df.hint("rebalance", "client_id", "split")
    spread.sortWithinPartitions("client_id", "split", "row_id").write.mode(mode).partitionBy(
        "client_id", "split"
    ).parquet(path)


def scan_partition(
    spark: SparkSession, path: str, client_id: int | str | None = None, split: str | None = None
) -> DataFrame:
    """Rows of one silo and split; both filters prune directories. Without a silo it reads every silo's split."""
    df = spark.read.parquet(path)
    if client_id is not None:
        df = df.where(F.col("client_id") == F.lit(client_id))
    if split is not None:
        df = df.where(F.col("split") == F.lit(split))
    return df


def scan_all_test(spark: SparkSession, path: str) -> DataFrame:
    return scan_partition(spark, path, split="test")


def scan_all_train(spark: SparkSession, path: str) -> DataFrame:
    return scan_partition(spark, path, split="train")


def melt(wide: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Wide result matrix (one column per silo) to long rows; empty cells are dropped."""
    columns = [c for c in wide.columns if c not in keys]
    typed = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def scan_metric_matrix(wide: DataFrame) -> DataFrame:
    return melt(wide, [c for c in ("round", "evaluator", "class") if c in wide.columns], "silo", "value")


def scan_distance_matrix(wide: DataFrame) -> DataFrame:
    return melt(wide, ["src"], "tgt", "value")


def column_names(df: DataFrame, column: str) -> list[str]:
    """Distinct values that become columns of a report; bounded by the number of silos."""
    rows = df.select(F.col(column).cast("string").alias("v")).distinct().orderBy("v").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError(f"{column} has more than 10,000 values; keep the long form")
    return [r.v for r in rows]


def to_matrix(
    long: DataFrame, keys: list[str], column: str, value: str = "value", names: list[str] | None = None,
    decimals: int | None = None,
) -> DataFrame:
    names = column_names(long, column) if names is None else names
    cell: Column = F.first(value, ignorenulls=True)
    wide = long.groupBy(*keys).pivot(column, names).agg(cell)
    if decimals is None:
        return wide
    return wide.select(*keys, *[F.round(F.col(f"`{n}`"), decimals).alias(n) for n in names])


def sink_evaluation(evaluation: DataFrame, metric: str, names: list[str] | None = None) -> DataFrame:
    """Rounds × (silos, Global, Aggregated), with a class level when the metric has one; 15 decimals."""
    rows = evaluation.where(F.col("metric") == metric)
    keys = ["round", "class"] if "class" in evaluation.columns else ["round"]
    return to_matrix(rows, keys, "evaluator", names=names, decimals=15)


def sink_shapley(sv: DataFrame, metric: str, names: list[str] | None = None) -> DataFrame:
    """(round, evaluator[, class]) × silos."""
    rows = sv.where(F.col("metric") == metric)
    keys = ["round", "evaluator", "class"] if "class" in sv.columns else ["round", "evaluator"]
    return to_matrix(rows, keys, "client_id", names=names, decimals=15)


def sink_distances(distance: DataFrame, measure: str, names: list[str] | None = None) -> DataFrame | None:
    """Source silo × (Global, target silos) of one measure; nothing to write when the measure has no rows."""
    rows = distance.where(F.col("measure") == measure)
    if rows.isEmpty():
        return None
    return to_matrix(rows, ["src"], "tgt", names=names)


def write_report(wide: DataFrame, path: str) -> None:
    """A result matrix as CSV with header. It has one row per round or silo, so one file is enough."""
    wide.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_reports(long: DataFrame, path: str, sink: Callable[[DataFrame, str, list[str]], DataFrame | None], names: list[str], by: str = "metric") -> dict[str, str]:
    """Every metric's (or measure's) matrix as CSV in a folder of its own: its name → the schema to read it with.

    A metric with classes keeps its class level; one without has no such column. Metrics without rows are not written. The
    long table is read once per metric, so it should be a stored one.
    """
    found = long.groupBy(by).agg(F.max(F.col("class").isNotNull()).alias("classes") if "class" in long.columns else F.lit(False).alias("classes"))
    schemas = {}
    for r in found.orderBy(by).collect():
        wide = sink(long if r["classes"] or "class" not in long.columns else long.drop("class"), r[by], names)
        if wide is not None:
            write_report(wide, f"{path}/{r[by]}")
            schemas[r[by]] = ", ".join(f"`{c}` {'double' if c in names else t}" for c, t in wide.dtypes)
    return schemas


def scan_reports(spark: SparkSession, path: str, schemas: dict[str, str], melt_one: Callable[[DataFrame], DataFrame], by: str = "metric") -> DataFrame:
    """What ``write_reports`` has written, as one long table; ``class`` is null where a metric has none."""
    parts = []
    for name, schema in schemas.items():
        part = melt_one(scan_csv(spark, f"{path}/{name}", schema)).withColumn(by, F.lit(name))
        parts.append(part)
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return table

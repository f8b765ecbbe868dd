"""Checkpoints and scratch folders in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

BROADCAST_BYTES = 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where nothing is set in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="silovalue-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: its strings and arrays, and 16 bytes for each other value."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary", "varchar", "char"):
            own = F.octet_length(column) + 16
        elif kind == "array" and field.dataType.elementType.typeName() in ("double", "float", "long", "integer"):
            own = 8 * F.size(column) + 32
        elif kind in ("array", "map", "struct", "variant"):
            own = F.length(F.to_json(F.struct(column))) * 2 + 32
        else:
            own = F.lit(16)
        total = total + F.coalesce(own.cast("bigint"), F.lit(16).cast("bigint"))
    return total


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint and the bytes of its rows, added up by the job that writes it."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, F.sum(row_bytes(df)).alias("bytes")))
    return table, seen.get["bytes"] or 0


def control_table(df: DataFrame) -> DataFrame:
    """Checkpoints an aggregate that later steps read several times (counts, utilities, sums of model size).

    It keeps its partitions: what fans out from it, coalitions or pairs, is dealt by its own key.
    """
    return cut_lineage(df)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The side of a join that should be small: sizes, bounds, model parameters of a silo.

    It is checkpointed and measured. Up to ``limit`` bytes are broadcast, so that the rows of the other side are not
    shuffled by a key that may be skewed; anything larger stays an ordinary join side, with the same result.
    """
    table, size = measured(df)
    return F.broadcast(table) if size <= limit else table


def partitioned_copy(df: DataFrame, by: str) -> DataFrame:
    """Rows stored in the shared folder by one column: jobs that take one value at a time read only its directory.

    The rebalance hint lets a value that holds a third of the rows be written by many tasks.
    """
    path = scratch_path(df.sparkSession, by)
    df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

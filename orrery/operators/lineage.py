"""Cutting lineage through files in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Of shuffles in rounds, before small ones are joined; up to this number Spark writes them without sorting in memory.
PARTITIONS = 200
#: Of a shuffle that one task of a round reads.
TASK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, whose files are deleted when the session's application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """df after a round trip through Parquet in the shared folder; executors may be lost without loss of these rows."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys) -> DataFrame:
    """df dealt to four tasks a core, by keys if given, where a row costs far more than its bytes tell. The number stays as it is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def dealt(df: DataFrame, *keys) -> DataFrame:
    """df dealt by keys, else by all its columns, to as many tasks as other shuffles, ahead of a hash table for each task.

    A task that reads a file holds all rows of a group in such a table, and a file of millions of rows may be one group.
    Only values deal, so that a task that runs again deals alike.
    """
    keys = keys or df.columns
    return df.repartition(*keys) if keys else df


@contextmanager
def sized_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside are broadcast by the size that a shuffle found, never by that of files.

    Files of repetitive terms are a small part of their rows, so that a table of millions would be broadcast through the driver.
    Nothing lazy may leave the block with a join in it.
    """
    static, found = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    with _set(spark, {found: spark.conf.get(found, None) or spark.conf.get(static), static: "-1"}):
        yield


@contextmanager
def small_tasks(df: DataFrame) -> Iterator[None]:
    """Shuffles that run inside are dealt by df's size to PARTITIONS at most, whose tasks read TASK_BYTES; frequent keys of a join are split.

    Shuffled terms take some thirty times their bytes in a sort. With as many tasks as cores, a task would hold its part of all facts.
    """
    spark, prefix = df.sparkSession, "spark.sql.adaptive."
    number = prefix + "coalescePartitions.initialPartitionNum"
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    fewest = int(spark.conf.get(number, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    new = {prefix + "advisoryPartitionSizeInBytes": str(TASK_BYTES), prefix + "skewJoin.skewedPartitionThresholdInBytes": str(2 * TASK_BYTES)}
    new[number] = str(max(fewest, min(PARTITIONS, 8 * size // TASK_BYTES)))
    with _set(spark, new):
        yield


@contextmanager
def _set(spark: SparkSession, new: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in new}  # None where only the default holds
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_rounds(f: Callable) -> Callable:
    """f, whose first argument is a DataFrame and whose joins are all run by ``written``, with ``sized_broadcasts`` and ``small_tasks``."""

    @wraps(f)
    def run(first: DataFrame, *args: Any, **more: Any) -> Any:
        with sized_broadcasts(first.sparkSession), small_tasks(first):
            return f(first, *args, **more)

    return run

"""Helpers that every operator of this subpackage uses to read tables, carry columns and cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append(df: DataFrame, fields: T.StructType, compute: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of ``keep``) and the ones that ``compute`` gives for each Arrow batch.

    A column of df that has the name of a new one is replaced. ``compute`` sees every column of df.
    """
    added = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in added and (keep is None or f.name in keep)]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + made, names=names)

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


#: Scratch files in a local folder have no checksum files beside them: each of these costs three more processes that set modes.
SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path inside the session's own checkpoint folder, deleted when the session's application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """df after a round trip through Parquet in the shared folder: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.options(**SCRATCH).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """As ``written``, in fewer files, for what comes out of a shuffle: its partitions may be many and small.

    A task takes at most eight shuffle partitions where there are many, one after the other, so that it needs no more memory
    than for one; and there are at least three tasks a core.
    """
    spark = df.sparkSession
    return written(df.coalesce(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a frame that ``written`` gave, once nothing needs them."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)

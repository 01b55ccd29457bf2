"""Materialised tables: build once, read back, rebuild on demand."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    A session in one process (``local[n]``) that names none gets a folder of its own, once; a cluster must name one,
    since a driver's local folder is not what executors see.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if base:
        return base
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    base = own_dir()
    spark.conf.set(CHECKPOINT_DIR, base)
    return base


@lru_cache(maxsize=1)
def own_dir() -> str:
    """A folder for sessions in one process; it goes when the process ends."""
    base = tempfile.mkdtemp(prefix="loomwright-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "loomwright", name, uuid.uuid4().hex)


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in a table in the shared folder: computed once, readable after any executor loss."""
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing reads any more; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that nothing refers to any more; it notices when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all cores where its source gives fewer partitions, as a small file does; for work that is heavy per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Read the Parquet table at ``path``; build and write it when absent or when forced."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err) and "UNABLE_TO_INFER_SCHEMA" not in str(err):
                raise
    writer = build().write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)
